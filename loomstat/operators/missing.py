"""Missing values: by column, in whole rows, and together."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .correlate import pearson
from .longform import position


def missing_table(df: DataFrame, columns: Iterable[str] | None = None, high_pct: float = 40.0) -> DataFrame:
    """missing_count, missing_pct (2 places, half-even), present_count, is_high; most missing first.

    One aggregate of counts over the wide rows: no long form, so that nothing but counts moves.
    """
    columns = list(columns or df.columns)
    n = F.count("*")
    parts = [F.struct(F.lit(c).alias("variable"), (n - F.count(F.col(c))).alias("missing_count"), F.count(F.col(c)).alias("present_count"), n.alias("n")) for c in columns]
    table = df.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))
    pct = F.coalesce(F.try_divide(F.col("missing_count") * 100.0, F.col("n")), F.lit(0.0))
    out = table.select("variable", "missing_count", F.bround(pct, 2).alias("missing_pct"), "present_count")
    return out.withColumn("is_high", F.col("missing_pct") > high_pct).orderBy(F.desc("missing_pct"), position(columns))


def missing_cells(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """One row: rows, columns, cells, missing cells and their share in percent."""
    columns = list(columns or df.columns)
    missing = F.coalesce(F.sum(sum((F.col(c).isNull().cast("long") for c in columns), F.lit(0))), F.lit(0))
    counts = df.agg(F.count("*").alias("n_rows"), missing.alias("n_missing"))
    cells = F.col("n_rows") * len(columns)
    return counts.select("n_rows", F.lit(len(columns)).cast("long").alias("n_columns"), cells.alias("n_cells"), "n_missing", F.try_divide(F.col("n_missing") * 100.0, cells).alias("missing_pct"))


def complete_cases(df: DataFrame, sets: dict[str, Iterable[str]]) -> DataFrame:
    """For each set of columns, rows in which all of them hold values: one pass for all sets."""
    parts = [
        F.struct(F.lit(name).alias("column_set"), F.lit(len(list(columns))).cast("long").alias("n_columns"), F.count_if(C.all_present(*columns)).alias("n_complete"), F.count("*").alias("n_rows"))
        for name, columns in sets.items()
    ]
    return df.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def missing_matrix(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """1 where a cell is missing, else 0; columns to ``keep`` stay as they are."""
    return df.select(*keep, *(F.col(c).isNull().cast("int").alias(c) for c in columns))


def missing_by_stretch(df: DataFrame, key: str, columns: Iterable[str], stretches: int = 200) -> DataFrame:
    """A26 for drawing: the share of missing cells of each column in ``stretches`` equal ranges of a numeric key: stretch, n_rows and the columns."""
    columns = list(columns)
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / stretches
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col(key) - F.col("lo"), step)), F.lit(0)), F.lit(stretches - 1)).cast("int")
    shares = (F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)
    return df.crossJoin(F.broadcast(ends)).groupBy(at.alias("stretch")).agg(F.count("*").alias("n_rows"), *shares).orderBy("stretch")  # one row to broadcast


def missing_corr(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Correlation of missingness of each pair of columns; pairs with a column that never or always misses drop out."""
    return pearson(missing_matrix(df, columns), columns, min_pairs=1).filter(F.col("r").isNotNull())


def co_missing(pairs: DataFrame, threshold: float = 0.70) -> DataFrame:
    """pairs with |r| from ``threshold`` on, names in order, r to 3 places half-even."""
    found = pairs.filter(F.abs("r") >= threshold)
    return found.select(F.least("variable_1", "variable_2").alias("variable_1"), F.greatest("variable_1", "variable_2").alias("variable_2"), F.bround("r", 3).alias("corr")).orderBy(F.desc(F.abs("corr")), "variable_1", "variable_2")


def expected(table: DataFrame, names: Iterable[str]) -> DataFrame:
    """Rows of a missing table that are high, with whether that was to be expected."""
    return table.filter("is_high").withColumn("expected", F.col("variable").isin(list(names)))


def readings_histogram(df: DataFrame, readings: Iterable[str]) -> DataFrame:
    """Rows by how many readings they hold."""
    return df.groupBy(C.count_present(*readings).alias("n_readings")).agg(F.count("*").alias("n_rows")).orderBy("n_readings")


def coverage(df: DataFrame, readings: Iterable[str]) -> DataFrame:
    """One row: rows, with any reading, with all, with the first, and gained by averaging over it."""
    readings = list(readings)
    counts = df.agg(F.count("*").alias("n_rows"), F.count_if(C.any_present(*readings)).alias("n_any"), F.count_if(C.all_present(*readings)).alias("n_all"), F.count(readings[0]).alias("n_first"))
    return counts.withColumn("n_gained", F.col("n_any") - F.col("n_first"))
