"""Row-wise expressions: null-aware means, flag rules, labels, bins and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(col: Column) -> Column:
    """NULL is the only marker of a missing value."""
    return F.nanvl(col, F.lit(None).cast("double"))


def count_present(*columns: str) -> Column:
    """how many of the columns hold a value."""
    return reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))


def any_present(*columns: str) -> Column:
    return F.coalesce(*columns).isNotNull()


def all_present(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def row_mean(*columns: str) -> Column:
    """mean of the values that are there; null if none is."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    return F.try_divide(total, F.nullif(count_present(*columns), F.lit(0)))


def null_unless(flag: Column, value, col: Column) -> Column:
    """``col`` where the flag equals ``value``; a missing flag voids it."""
    return F.when(flag.eqNullSafe(F.lit(value)), col)


def null_if(flag: Column, value, col: Column) -> Column:
    """``col`` but where the flag equals ``value``; a missing flag keeps it."""
    return F.when(~flag.eqNullSafe(F.lit(value)), col)


def label_of(code: Column, labels: dict) -> Column:
    """the code's label; null for other codes."""
    found = F
    for key, label in labels.items():
        found = found.when(code == F.lit(key), F.lit(label))
    return found.otherwise(F.lit(None).cast("string"))


def bin_of(value: Column, bins) -> Column:
    """label of the right-closed bin (above, up to, label) that holds the value; else null."""
    found = F
    for above, up_to, label in bins:
        found = found.when((value > above) & (value <= up_to), F.lit(label))
    return found.otherwise(F.lit(None).cast("string"))


def skew_class(skew: Column, heavy: float = 2.0, moderate: float = 1.0) -> Column:
    """strict thresholds; the side by the sign."""
    side = F.when(skew > 0, "right").otherwise("left")
    said = lambda words: F.concat(F.lit(f"{words} ("), side, F.lit(")"))
    return F.when(F.abs(skew) > heavy, said("HEAVILY SKEWED")).when(F.abs(skew) > moderate, said("Moderately skewed")).otherwise("Approximately symmetric")


def plausibility(value: Column, low: Column, high: Column) -> Column:
    """within the range, far outside it, or in between; a variable without a range is plausible."""
    inside = low.isNull() | high.isNull() | value.between(low, high)
    return (
        F.when(inside, "BIOLOGICALLY PLAUSIBLE")
        .when((value < low * 0.5) | (value > high * 2.0), "REQUIRES INVESTIGATION")
        .otherwise("SUSPICIOUS")
    )


def corr_level(r: Column, high: float = 0.75, very_high: float = 0.90) -> Column:
    """F12."""
    return F.when(F.abs(r) >= very_high, "VERY HIGH").when(F.abs(r) >= high, "HIGH")


def relative_diff_pct(a: Column, b: Column) -> Column:
    """(a - b) / b in percent; null where b is null or 0."""
    return F.when(b != 0, F.try_divide((a - b) * 100.0, b))
