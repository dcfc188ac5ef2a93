"""Connected components of a graph given as pairs of long node ids.

Edge cases: links from a node to itself and repeated links add nothing; links with a null end are
left out; no links give no rows; other columns are not taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _pairs(df: DataFrame) -> DataFrame:
    """Distinct pairs with parent < child."""
    return df.filter("child > parent").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours below the smallest of these."""
    least = pairs.groupBy("child").agg(F.min("parent").alias("least"))
    moved = pairs.join(least, "child").select(F.col("parent").alias("child"), F.col("least").alias("parent"))
    return _pairs(moved.unionByName(least.withColumnRenamed("least", "parent")))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours below its smallest neighbour (or itself, if smaller)."""
    # a parent's smallest neighbour is its own least parent, if it has one; its children are larger
    least = pairs.groupBy("child").agg(F.min("parent").alias("least"))
    up = least.select(F.col("child").alias("parent"), "least")
    return pairs.join(up, "parent", "left").select("child", F.coalesce("least", "parent").alias("parent"))


def _is_star(pairs: DataFrame) -> bool:
    """Whether each child has one parent, and no parent is a child."""
    ends = pairs.select(F.col("child").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        pairs.select(F.col("parent").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.filter("below > 1 or (below = 1 and above = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(child, parent) for each linked node but the smallest of its component, which is parent.

    ``links`` has two long columns in any order of ends. Alternating small and large stars
    need a number of rounds logarithmic in the longest path; each round is joins and
    map-side-combined minima by node, whose hot keys adaptive execution can split, and its
    pairs (never more than the round before had) are checkpointed. Nothing is collected.
    """
    a, b = links.columns
    pairs = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
    pairs = checkpointed(pairs.distinct())
    while not _is_star(pairs):
        pairs = checkpointed(_small_star(_large_star(pairs)))
    return pairs
