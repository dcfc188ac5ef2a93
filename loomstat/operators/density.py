"""Histograms and density curves from one aggregate of binned counts or weights."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .longform import with_rows
from .profile import quantiles

#: Bins of an automatic histogram at most: beyond, they are as wide as this number of them needs.
MOST_BINS = 10_000
#: Points of a density curve's grid, and how many bandwidths it goes beyond the values.
GRID, CUT = 512, 4.0


def _ends(long: DataFrame, by: list[str]) -> DataFrame:
    """n, lo, hi and std of the finite values of each group that has any."""
    finite = long.filter(F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    return finite.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.stddev_samp("value").alias("std"))


def _with(long: DataFrame, frame: DataFrame, by: list[str]) -> DataFrame:
    """The finite values with their group's row of ``frame``."""
    return with_rows(long.filter(F.col("value").isNotNull() & (F.abs("value") < float("inf"))), frame, by)


def auto_bins(long: DataFrame, by: Iterable[str] = ("variable",), most: int = MOST_BINS) -> DataFrame:
    """N, lo, hi, width and bins of an automatic histogram of each group.

    The width is the smaller of Freedman and Diaconis's (twice the interquartile range over the cube root of n)
    and Sturges' (the range over log2 n + 1), or Sturges' where the quartiles meet. A constant has one bin of width 1
    around it. There are at most ``most`` bins: a far value among close ones would ask for any number.
    """
    by = list(by)
    finite = long.withColumn("value", F.when(F.abs("value") < float("inf"), F.col("value")))
    q = quantiles(finite, (0.25, 0.75), by).select(*by, (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    both = _ends(long, by).drop("std").join(q, by)
    span = F.col("hi") - F.col("lo")
    sturges = span / (F.log2(F.col("n").cast("double")) + 1.0)
    scott = 2.0 * F.col("iqr") / F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0))
    width = F.when((scott > 0) & (scott < sturges), scott).otherwise(sturges)
    bins = F.least(F.ceil(F.try_divide(span, width)), F.lit(most))
    flat = span == 0
    return both.select(
        *by,
        "n",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        F.when(flat, 1.0).otherwise(span / bins).alias("width"),
        F.when(flat, F.lit(1)).otherwise(bins).cast("int").alias("bins"),
    )


def auto_histogram(long: DataFrame, by: Iterable[str] = ("variable",), most: int = MOST_BINS) -> DataFrame:
    """The histogram of each group by its own automatic bins: bin, low, high and n, empty bins too, the last one closed."""
    by = list(by)
    frame = auto_bins(long, by, most)
    place = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.col("bins").cast("long") - 1).cast("int")
    counts = _with(long, frame, by).groupBy(*by, place.alias("bin")).agg(F.count("*").alias("own"))
    every = frame.select(*by, "lo", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    edge = lambda k: F.col("lo") + k * F.col("width")
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("own", F.lit(0)).cast("long").alias("n"))


def density(long: DataFrame, by: Iterable[str] = ("variable",), grid: int = GRID, cut: float = CUT) -> DataFrame:
    """The Gaussian kernel density of each group on a grid: point, x, density, bandwidth and error_bound.

    The bandwidth h follows Scott's rule, the sample deviation over the fifth root of n; the grid of ``grid`` points
    reaches ``cut`` bandwidths beyond the values, so that the curve's total is 1 but for the kernel's tails there.
    Each value's weight is shared between the two grid points beside it, in one aggregate, and the grid's weights are
    convolved with the kernel. That is the density with a kernel linear between points d apart, so it differs
    from the direct sum over all values by at most d^2 / 8 times the kernel's largest curvature: d^2 / (8 sqrt(2 pi) h^3),
    which ``error_bound`` tells. Groups of fewer than two values, or of equal ones, have no curve; infinities take no part.
    """
    by = list(by)
    ends = _ends(long, by).filter("n > 1 and std > 0")
    frame = ends.withColumn("h", F.col("std") / F.pow(F.col("n").cast("double"), F.lit(0.2)))
    frame = frame.select(*by, "n", "h", (F.col("lo") - cut * F.col("h")).alias("first"), ((F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (grid - 1)).alias("step"))
    at = (F.col("value") - F.col("first")) / F.col("step")
    left = F.least(F.floor(at), F.lit(grid - 2))
    shared = _with(long, frame, by).select(*by, left.cast("int").alias("left"), (at - left).alias("part"))
    sums = shared.groupBy(*by, "left").agg(F.sum(1.0 - F.col("part")).alias("near"), F.sum("part").alias("far"))
    parts = sums.select(*by, F.inline(F.array(F.struct(F.col("left").alias("point"), F.col("near").alias("weight")), F.struct((F.col("left") + 1).alias("point"), F.col("far").alias("weight")))))
    # a group's weights are as many as the grid's points
    weights = parts.groupBy(*by, "point").agg(F.sum("weight").alias("weight")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("point", "weight"))).alias("weights"))

    def kernel(x: Column, w: Column) -> Column:
        u = (x - w["point"]) * F.col("step") / F.col("h")
        return w["weight"] * F.exp(-u * u / 2.0)

    points = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda g: F.struct(g.alias("point"), F.aggregate("weights", F.lit(0.0), lambda s, w: s + kernel(g, w)).alias("total")))
    curve = weights.join(frame, by).select(*by, "n", "h", "first", "step", F.inline(points))
    scale = F.col("n") * F.col("h") * math.sqrt(2 * math.pi)
    bound = F.col("step") * F.col("step") / (8 * math.sqrt(2 * math.pi) * F.pow("h", F.lit(3.0)))
    return curve.select(*by, "point", (F.col("first") + F.col("point") * F.col("step")).alias("x"), (F.col("total") / scale).alias("density"), F.col("h").alias("bandwidth"), bound.alias("error_bound"))
