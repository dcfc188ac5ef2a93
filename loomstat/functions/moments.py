"""Aggregates: bias-corrected moments and exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)


def _constant_or(n: Column, least: int, constant: Column, value: Column) -> Column:
    return F.when(n >= least, F.when(constant, 0.0).otherwise(value))


def corrected_skewness(name: str) -> Column:
    """Sample skewness G1; 0 for a constant, null below 3 values."""
    n = F.count(name).cast("double")
    g1 = F.skewness(name)
    return _constant_or(n, 3, F.min(name) == F.max(name), g1 * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def corrected_kurtosis(name: str) -> Column:
    """A10: sample excess kurtosis G2; 0 for a constant, null below 4 values."""
    n = F.count(name).cast("double")
    g2 = F.kurtosis(name)
    value = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return _constant_or(n, 4, F.min(name) == F.max(name), value)


def exact_quantiles(name: str, probabilities=QUARTILES) -> Column:
    """Linearly interpolated, as one array."""
    return F.percentile(name, F.array(*(F.lit(p) for p in probabilities)))
