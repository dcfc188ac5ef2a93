"""Doubles as 64-bit integers in the same order, and back, on built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The layout of a double
_MANTISSA, _BIAS, _LEAST = 52, 1023, -1022
_INFINITE = 0x7FF << _MANTISSA


def with_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name``: a long for each double, smaller for smaller ones, 0 for both zeros, the negative of the absolute value's below.

    The exponent comes from a logarithm and is put right by comparisons with powers of two, which
    are exact, as is the division by one. NaN and null give null.
    """
    size, guess, exponent = (f"{name}_{part}" for part in ("size", "guess", "exponent"))
    two = lambda e: F.pow(F.lit(2.0), e)
    df = df.withColumn(size, F.abs(F.col(value).cast("double")))
    # a guess from the top half of the range would overflow when it is doubled
    df = df.withColumn(guess, F.least(F.greatest(F.floor(F.log2(size)), F.lit(_LEAST)), F.lit(_BIAS)))
    df = df.withColumn(exponent, F.col(guess) + (F.col(size) >= two(F.col(guess) + 1)).cast("long") - (F.col(size) < two(F.col(guess))).cast("long"))
    plain = (F.col(exponent) + _BIAS) * (1 << _MANTISSA) + ((F.col(size) / two(F.col(exponent)) - 1.0) * float(1 << _MANTISSA)).cast("long")
    tiny = (F.col(size) * two(F.lit(537.0)) * two(F.lit(537.0))).cast("long")  # below the least exponent: in units of 2^-1074
    bits = (
        F.when(F.isnan(value), F.lit(None))
        .when(F.col(size) == float("inf"), F.lit(_INFINITE))
        .when(F.col(size) < 2.0**_LEAST, tiny)
        .otherwise(plain)
    )
    return df.withColumn(name, F.when(F.col(value) < 0, -bits).otherwise(bits)).drop(size, guess, exponent)


def from_bits(bits: Column) -> Column:
    """The double of a long that ``with_bits`` made."""
    size = F.abs(bits)
    exponent, mantissa = F.shiftright(size, _MANTISSA), size.bitwiseAND((1 << _MANTISSA) - 1)
    plain = (mantissa / float(1 << _MANTISSA) + 1.0) * F.pow(F.lit(2.0), exponent - _BIAS)
    value = F.when(exponent == 0, mantissa * F.pow(F.lit(2.0), F.lit(-1074.0))).when(exponent == 0x7FF, F.lit(float("inf"))).otherwise(plain)
    return F.when(bits < 0, -value).otherwise(value)
