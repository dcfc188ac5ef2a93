"""Distributions: describe, corrected moments, exact quantiles, histograms, boxes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import moments as M
from .longform import estimated_bytes, with_rows
from .selection import radix_quantiles

#: Input bytes (as the optimizer estimates) up to which quantiles come from one map of values for each group.
IN_MEMORY = 128 << 20

def describe(long: DataFrame, by: Iterable[str] = ("variable",)) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, nulls ignored."""
    by = list(by)
    stats = long.groupBy(*by).agg(
        F.count("value").alias("n_valid"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return _with_quantiles(stats, long, by)


def shape(long: DataFrame, by: Iterable[str] = ("variable",)) -> DataFrame:
    """n_valid with bias-corrected skewness and excess kurtosis."""
    return long.groupBy(*by).agg(F.count("value").alias("n_valid"), M.corrected_skewness("value").alias("skewness"), M.corrected_kurtosis("value").alias("kurtosis"))


def quantiles(long: DataFrame, probabilities=M.QUARTILES, by: Iterable[str] = ("variable",), in_memory: int = IN_MEMORY) -> DataFrame:
    """Exact, linearly interpolated quantiles: the group columns and ``q``, an array.

    Nulls and NaN are left out; between opposite infinities a quantile is null. Small inputs take Spark's
    exact percentile, which holds all distinct values of a group in one map; larger ones radix selection, with the same results.
    """
    by = list(by)
    if estimated_bytes(long) > in_memory:
        return radix_quantiles(long, probabilities, by)
    values = long.select(*by, C.nan_to_null(F.col("value").cast("double")).alias("value")).filter(F.col("value").isNotNull())
    exact = values.groupBy(*by).agg(M.exact_quantiles("value", probabilities).alias("q")).filter(F.col("q").isNotNull())
    return exact.withColumn("q", F.transform("q", C.nan_to_null))


def _with_quantiles(stats: DataFrame, long: DataFrame, by: list[str]) -> DataFrame:
    found = quantiles(long, by=by).select(*by, *(F.col("q")[k].alias(name) for k, name in enumerate(("p25", "median", "p75"))))
    return stats.join(found, by, "left") if by else stats.crossJoin(found)


def distributions(long: DataFrame, heavy: float = 2.0, moderate: float = 1.0, min_values: int = 10) -> DataFrame:
    """Phase 3's table: describe and shape of each variable with enough values, and its class.

    The class goes by the unrounded skewness, the columns are rounded half-even to 4 places.
    """
    both = describe(long).join(shape(long).drop("n_valid"), "variable").filter(F.col("n_valid") >= min_values)
    rounded = {c: F.bround(c, 4) for c in ("mean", "std", "min", "p25", "median", "p75", "max", "skewness", "kurtosis")}
    classed = both.withColumn("skew_class", C.skew_class(F.col("skewness"), heavy, moderate)).withColumns(rounded)
    return classed.select("variable", "n_valid", "mean", "std", "min", "p25", "median", "p75", "max", "skewness", "kurtosis", "skew_class")


# Bytes of a value of each type of fixed size
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8}


def type_frequency(df: DataFrame) -> DataFrame:
    """For each type its columns, the values they hold and their bytes, in one aggregate over the rows; bytes of nested types are not told."""
    by_type: dict[str, list[str]] = {}
    for name, kind in df.dtypes:
        by_type.setdefault(kind, []).append(name)
    none = F.lit(None).cast("long")

    def held(kind: str, names: list[str]) -> Column:
        present = sum((F.count(F.col(c)) for c in names), F.lit(0))
        sizes = sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in names), F.lit(0)) if kind in ("string", "binary") else present * _WIDTHS[kind] if kind in _WIDTHS else none
        return F.struct(F.lit(kind).alias("type"), F.lit(len(names)).cast("long").alias("n_columns"), present.cast("long").alias("n_values"), sizes.cast("long").alias("n_bytes"))

    return df.agg(F.array(*(held(k, names) for k, names in by_type.items())).alias("parts")).select(F.inline("parts")).orderBy(F.desc("n_columns"), "type")


def scalars(df: DataFrame, value: str) -> DataFrame:
    """One row: minimum and maximum (as integers), mean (1 place, half-even) and median."""
    ends = df.agg(F.min(value).cast("int").alias("min"), F.max(value).cast("int").alias("max"), F.bround(F.avg(F.col(value).cast("double")), 1).alias("mean"))
    middle = quantiles(df.select(F.col(value).cast("double").alias("value")), (0.5,), by=())
    return ends.crossJoin(F.broadcast(middle.select(F.col("q")[0].alias("median"))))  # one row each


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed: bin, low, high, n (empty bins too); NaN is missing."""
    df = df.withColumn(value, C.nan_to_null(F.col(value).cast("double")))
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = F.try_divide(F.col("hi") - F.col("lo"), F.lit(float(bins)))
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    frame = ends.filter("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    edges = frame.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"))
    return edges.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _boxed(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The values of each group with its quartiles."""
    long = df.select(*by, C.nan_to_null(F.col(value).cast("double")).alias("value"))
    q = quantiles(long, by=by).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    if not by:
        return long.crossJoin(F.broadcast(q))  # one row
    return with_rows(long, q.join(long.groupBy(*by).agg(F.count("*").alias("n")), by), by)


def box_stats(df: DataFrame, value: str, by: Iterable[str] = (), fence: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (the furthest values within the fences) and the number of fliers, by group."""
    by = list(by)
    low, high = _fence("q1", "q3", -fence), _fence("q1", "q3", fence)
    inside = F.col("value").between(low, high)
    return _boxed(df, value, by).groupBy(*by, "q1", "median", "q3").agg(
        F.count("value").alias("n_valid"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if((F.col("value") < low) | (F.col("value") > high)).alias("n_fliers"),
    )


def fliers(df: DataFrame, value: str, by: Iterable[str] = (), fence: float = 1.5) -> DataFrame:
    """The values beyond the fences themselves: the group, value, side and n, in order of group and value.

    Equal values are counted together before they are shuffled; the order is by ranges, so that no task holds a group.
    """
    by = list(by)
    low, high = _fence("q1", "q3", -fence), _fence("q1", "q3", fence)
    beyond = _boxed(df, value, by).filter((F.col("value") < low) | (F.col("value") > high))
    side = F.when(F.col("value") < low, "low").otherwise("high").alias("side")
    return beyond.groupBy(*by, "value", side).agg(F.count("*").alias("n")).orderBy(*by, "value")


def flier_bins(df: DataFrame, value: str, by: Iterable[str] = (), bins: int = 200, fence: float = 1.5) -> DataFrame:
    """A25 for drawing: fliers counted in ``bins`` places between the least and the greatest of their group: place (their middle) and n."""
    by = list(by)
    beyond = fliers(df, value, by, fence)
    ends = beyond.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    met = beyond.join(ends, by) if by else beyond.crossJoin(F.broadcast(ends))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("lo"), step)), F.lit(0)), F.lit(bins - 1))
    return met.groupBy(*by, (F.col("lo") + (at + 0.5) * step).alias("place")).agg(F.sum("n").alias("n")).orderBy(*by, "place")


def _fence(q1: str, q3: str, times: float) -> Column:
    edge = F.col(q1) if times < 0 else F.col(q3)
    return edge + times * (F.col(q3) - F.col(q1))
