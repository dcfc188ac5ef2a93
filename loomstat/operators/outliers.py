"""Tukey fences and what lies beyond them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .profile import quantiles


def fences(long: DataFrame, mild: float = 1.5, extreme: float = 3.0, min_values: int = 1) -> DataFrame:
    """q1, q3, iqr and both pairs of fences by variable, for variables with enough values."""
    ends = long.groupBy("variable").agg(F.count("value").alias("n_valid"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = quantiles(long, (0.25, 0.75)).select("variable", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    q = ends.filter(F.col("n_valid") >= min_values).join(quartiles, "variable", "left")
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        "variable",
        "n_valid",
        "q1",
        "q3",
        iqr.alias("iqr"),
        (F.col("q1") - mild * iqr).alias("lower_mild"),
        (F.col("q3") + mild * iqr).alias("upper_mild"),
        (F.col("q1") - extreme * iqr).alias("lower_extreme"),
        (F.col("q3") + extreme * iqr).alias("upper_extreme"),
        F.col("min").alias("min_value"),
        F.col("max").alias("max_value"),
    )


def _outside(low: str, high: str) -> Column:
    return (F.col("value") < F.col(low)) | (F.col("value") > F.col(high))


def outlier_counts(long: DataFrame, ranges: dict[str, tuple[float, float]], mild: float = 1.5, extreme: float = 3.0, min_values: int = 1) -> DataFrame:
    """Outliers by variable, strictly beyond the fences; mild ones include the extreme, which are classed by plausibility."""
    spark = long.sparkSession
    known = spark.createDataFrame([(v, float(a), float(b)) for v, (a, b) in ranges.items()], "variable string, low double, high double")
    # both sides have a row for each variable: a size given by the catalogue
    lines = fences(long, mild, extreme, min_values).join(F.broadcast(known), "variable", "left")
    met = long.filter(F.col("value").isNotNull()).join(F.broadcast(lines), "variable")
    far = _outside("lower_extreme", "upper_extreme")
    kind = C.plausibility(F.col("value"), F.col("low"), F.col("high"))
    of = lambda name: F.count_if(far & (kind == name))
    keys = ("variable", "n_valid", "q1", "q3", "iqr", "lower_mild", "upper_mild", "max_value", "min_value")
    counts = met.groupBy(*keys).agg(
        F.count_if(_outside("lower_mild", "upper_mild")).alias("n_mild_outliers"),
        F.count_if(far).alias("n_extreme_outliers"),
        of("BIOLOGICALLY PLAUSIBLE").alias("n_plausible"),
        of("SUSPICIOUS").alias("n_suspicious"),
        of("REQUIRES INVESTIGATION").alias("n_requires_inv"),
    )
    pct = lambda c: F.bround(F.col(c) * 100.0 / F.col("n_valid"), 2)
    return counts.withColumns({"pct_mild": pct("n_mild_outliers"), "pct_extreme": pct("n_extreme_outliers")})
