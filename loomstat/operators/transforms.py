"""The ordered cleaning rules: averages, range filter, null rules, derived columns.

Each is a projection or filter on built-in expressions; composed, they collapse into one stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..catalog import Derived
from ..functions import columns as C
from .quality import require_columns


def average_readings(df: DataFrame, readings: dict[str, tuple[str, ...]]) -> DataFrame:
    """a null-skipping mean for each set of repeated readings."""
    require_columns(df, [c for cs in readings.values() for c in cs], "averages")
    return df.withColumns({name: C.row_mean(*columns) for name, columns in readings.items()})


def range_filter(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows with low <= value <= high; a null value goes."""
    return require_columns(df, [column], "range filter").filter(F.col(column).between(low, high))


def null_unless_valid(df: DataFrame, flag: str, value, columns: Iterable[str]) -> DataFrame:
    """The columns keep their values only where the flag equals ``value``."""
    columns = list(columns)
    require_columns(df, [flag, *columns], "validity rule")
    return df.withColumns({c: C.null_unless(F.col(flag), value, F.col(c)) for c in columns})


def null_if_flagged(df: DataFrame, flag: str, value, columns: Iterable[str]) -> DataFrame:
    """The columns lose their values where the flag equals ``value``."""
    columns = list(columns)
    require_columns(df, [flag, *columns], "flag rule")
    return df.withColumns({c: C.null_if(F.col(flag), value, F.col(c)) for c in columns})


def derive(df: DataFrame, definitions: Iterable[Derived]) -> DataFrame:
    """The columns that the definitions compute."""
    definitions = list(definitions)
    require_columns(df, [c for d in definitions for c in d.inputs], "derived columns")
    return df.withColumns({d.name: F.expr(d.expression) for d in definitions})


def null_changes(before: DataFrame, rule: dict[str, Column]) -> DataFrame:
    """For each column, its nulls before and after the rule's expression, in one pass."""
    parts = [
        F.struct(F.lit(c).alias("variable"), F.count_if(F.col(c).isNull()).alias("n_null_before"), F.count_if(new.isNull()).alias("n_null_after"))
        for c, new in rule.items()
    ]
    return before.agg(F.array(*parts).alias("parts")).select(F.inline("parts")).withColumn("n_nulled", F.col("n_null_after") - F.col("n_null_before"))


def observed(df: DataFrame, steps: list[tuple[str, str, Callable[[DataFrame], DataFrame]]], columns: Iterable[str]) -> tuple[DataFrame, list[Observation]]:
    """A04 in passing: ``df`` after all steps, and observations of rows and of nulls in ``columns`` (those there are) before the first and after each.

    Nothing is read for them: whatever writes the result gathers them. Steps of one stage count a task that is tried again once.
    """
    columns, points = list(columns), []
    for k in range(len(steps) + 1):
        if k:
            df = df.transform(steps[k - 1][2])
        points.append(Observation(f"point{k}"))
        df = df.observe(points[-1], F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns if c in df.columns))
    return df, points


CHANGES = "decision string, label string, variable string, n_rows_before long, n_rows_after long, n_null_before long, n_null_after long"


def told_changes(steps: list[tuple[str, str, Callable[[DataFrame], DataFrame]]], points: list[Observation], columns: Iterable[str]) -> list[tuple]:
    """The rows of a report on what each step changed, for each column that it made or whose nulls or rows it changed."""
    counts, rows = [p.get for p in points], []
    for (number, label, _), before, after in zip(steps, counts, counts[1:]):
        for c in columns:
            if c in after and (c not in before or before[c] != after[c] or before["rows"] != after["rows"]):
                rows.append((number, label, c, before["rows"], after["rows"], before.get(c), after[c]))
    return rows
