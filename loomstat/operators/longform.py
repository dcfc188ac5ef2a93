"""The tidy form that all profiles start from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null

#: Values from which a group is heavy.
HEAVY = 1_000_000
#: Bytes from which an estimate of the optimizer is a guess: of data of unknown size it takes 8 EiB.
GUESSED = 1 << 50


def to_long(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """(keep..., variable, value): one row a cell, values as double, nulls kept; NaN becomes null."""
    columns, keep = list(columns), list(keep)
    plain = df.select(*keep, *(nan_to_null(F.col(c).cast("double")).alias(c) for c in columns))
    return plain.unpivot([F.col(k) for k in keep], columns, "variable", "value")


def with_rows(long: DataFrame, frame: DataFrame, by: Iterable[str], heavy: int = HEAVY) -> DataFrame:
    """``long`` with its group's row of ``frame``, in which ``n`` is the group's number of values; no task takes a heavy group's values together.

    Variables are columns of a table, so their rows are broadcast. By other columns there may be any number of groups, but of heavy ones
    only as many as ``heavy`` goes into the rows: these are broadcast, and the values of the others alone are shuffled.
    """
    by = list(by)
    if by == ["variable"]:
        return long.join(F.broadcast(frame), by)
    large = F.broadcast(frame.filter(F.col("n") > heavy))
    others = long.join(large, by, "left_anti").join(frame.filter(F.col("n") <= heavy), by)
    return long.join(large, by).unionByName(others)


def position(columns: Iterable[str], variable: str | Column = "variable") -> Column:
    """The place of a variable in ``columns``, from 0."""
    return F.array_position(F.lit(list(columns)), F.col(variable) if isinstance(variable, str) else variable) - 1


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``, without running a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def known_bytes(df: DataFrame) -> int:
    """``estimated_bytes``, but where that is no more than a guess (of an RDD, say) 8 bytes a cell, for which the rows are counted."""
    estimate = estimated_bytes(df)
    return estimate if estimate < GUESSED else 8 * len(df.columns) * df.count()
