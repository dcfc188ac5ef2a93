"""Pairwise-complete Pearson correlation and what follows from it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .comoments import pairwise
from .longform import position

def pearson(df: DataFrame, columns: Iterable[str], min_pairs: int = 30) -> DataFrame:
    """variable_1, variable_2, n_pairs and r of each pair, the first before the second in ``columns``.

    r is null below ``min_pairs`` complete pairs, where one side is constant among them, or where one is
    infinite; NaN is missing. One pass over the data, whatever the number of columns; only blocks of
    co-moments are shuffled: rows are never paired with each other.
    """
    columns = list(columns)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "variable_1 string, variable_2 string, n_pairs long, r double")
    names = F.lit(columns)
    at = lambda k: F.element_at(names, F.col(k) + 1)
    return pairwise(df, columns, min_pairs).select(at("i").alias("variable_1"), at("j").alias("variable_2"), "n_pairs", "r")


def matrix(pairs: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The square matrix of ``pairs``: a row for each variable, in order, with a column for each; 1 on the diagonal."""
    columns = list(columns)
    both = pairs.select("variable_1", "variable_2", "r").unionByName(pairs.select(F.col("variable_2").alias("variable_1"), F.col("variable_1").alias("variable_2"), "r"))
    ones = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "variable_1 string, variable_2 string, r double")
    wide = both.unionByName(ones).groupBy(F.col("variable_1").alias("variable")).pivot("variable_2", columns).agg(F.first("r"))
    return wide.orderBy(position(columns))


def high_pairs(pairs: DataFrame, high: float = 0.75, very_high: float = 0.90) -> DataFrame:
    """Pairs with |r| from ``high`` on: pearson_r and abs_r to 4 places half-even, and level by the unrounded r."""
    found = pairs.filter(F.abs("r") >= high)
    return found.select("variable_1", "variable_2", F.bround("r", 4).alias("pearson_r"), F.bround(F.abs("r"), 4).alias("abs_r"), C.corr_level(F.col("r"), high, very_high).alias("level")).orderBy(F.desc("abs_r"), "variable_1", "variable_2")


def redundant(features: Iterable[str], known: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """the known (raw, derived) pairs of which both are features, whatever their r."""
    features = set(features)
    return [(a, b) for a, b in known if a in features and b in features]


def noted(pairs: DataFrame, notes: dict[frozenset, str]) -> DataFrame:
    """``pairs`` with the note on each unordered pair, or null."""
    key: Column = F.array_sort(F.array("variable_1", "variable_2"))
    found = F
    for pair, note in notes.items():
        found = found.when(key == F.array(*map(F.lit, sorted(pair))), F.lit(note))
    return pairs.withColumn("note", found.otherwise(F.lit(None).cast("string")) if notes else F.lit(None).cast("string"))
