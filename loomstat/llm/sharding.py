"""Sharding by k-d tree partitioning.

A node that still has to yield k shards is split along its widest metadata dimension (widths
measured against the whole table's) at the weighted median that gives its halves bytes in
proportion to their shards, until each leaf is one shard. Medians are found for all nodes of
a level at once by distributed histograms of bytes: each pass counts a node's open bracket in
bins and closes in on the bin which holds the median, down to a single document.

A document's place in a dimension is its value with a hash of the row below it, so a value
that holds a third of all rows is cut as evenly as any other. Only bins (a bounded number for
each node) go to the driver; documents stay in one checkpointed table of their metadata.

Edge cases: a null or empty text weighs the fixed cost alone; null metadata are a value of
their own; rows equal in everything are still told apart and spread; fewer rows than shards
leave shards empty; an empty table gives no rows; other columns are not carried by ``query``.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, globally_ranked, table

SHARDS = 40
#: Bytes that each document weighs besides its text.
COST = 16
#: Bins of a node's open bracket in each pass, fewer where there are many nodes: so many in all.
BINS, LEAST_BINS, MOST_BINS = 1024, 16, 1 << 20
#: Leaves at most of a tree whose cuts stand in one SQL expression, and levels of a larger one that are told by tables of cuts.
MOST_SHARDS, DEPTH = 1024, 5
#: Shards at most whose first ranks and nodes are broadcast.
BROADCAST_SHARDS = 1 << 20
#: Bits of a key below the dimension's value: a hash of the row, of which the last bits spread rows that are equal.
LOW, TIE = 32, 12


@dataclass
class Node:
    """A region with ``shards`` to yield, the first of them numbered ``first``."""

    first: int
    shards: int
    dimension: int = 0
    threshold: int = 0
    left: Node | None = None
    right: Node | None = None
    # while its median is sought
    low: int = 0
    high: int = 0
    below: int = 0
    aim: float = 0.0

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def route(self) -> str:
        """SQL for the leaf that a row lies in: the first of its shards."""
        if self.left is None:
            return f"{self.first}L"
        return f"CASE WHEN key{self.dimension} < {self.threshold}L THEN {self.left.route()} ELSE {self.right.route()} END"


def _hashed_value(col: Column) -> Column:
    """A 31-bit place for a text; equal texts share it, null has 0."""
    return F.coalesce(F.shiftright(F.crc32(col), 1), F.lit(0)).cast("long")


def _scaled_log(col: Column) -> Column:
    """A 31-bit place for a count, on a logarithmic scale."""
    return (F.log2(F.coalesce(col, F.lit(0)) + 1.0) * (1 << 25)).cast("long")


def _local(points: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each of some nodes, which are at most as many as shards."""
    df = points.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_SHARDS else df


def _key(dimensions: int) -> str:
    return "CASE dimension " + " ".join(f"WHEN {d} THEN key{d}" for d in range(dimensions)) + " END"


def located(points: DataFrame, tops: list[Node], dimensions: int) -> DataFrame:
    """``points`` with ``node``: the leaf that each lies in. Those of several ``tops`` have the one of these that they lie in there."""
    if len(tops) == 1:
        return points.withColumn("node", F.expr(tops[0].route()))
    level = [n for n in tops if n.left is not None]
    while level:
        # a node's left half has its number
        cuts = _local(points, [(n.first, n.dimension, n.threshold, n.right.first) for n in level], "node long, dimension int, threshold long, right long")
        moved = f"CASE WHEN threshold IS NOT NULL AND {_key(dimensions)} >= threshold THEN right ELSE node END"
        points = points.join(cuts, "node", "left").withColumn("node", F.expr(moved)).drop("dimension", "threshold", "right")
        level = [c for n in level for c in (n.left, n.right) if c.left is not None]
    return points


def _medians(placed: DataFrame, seeking: list[Node], dimensions: int) -> None:
    """Set each node's threshold, narrowing the brackets of all of them together."""
    while seeking:
        bins = min(BINS, max(LEAST_BINS, MOST_BINS // len(seeking)))
        sought = _local(placed, [(n.first, n.dimension, n.low, n.high, (n.high - n.low) // bins + 1) for n in seeking], "node long, dimension int, low long, high long, step long")
        keyed = placed.join(sought, "node").select("node", "size", F.expr(_key(dimensions)).alias("key"), "low", "high", "step")
        counted = (
            keyed.filter("key BETWEEN low AND high")
            .groupBy("node", F.expr("(key - low) div step").alias("bin"))
            .agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()
        )
        by_node: dict[int, list] = {}
        for b in sorted(counted, key=lambda b: b["bin"]):
            by_node.setdefault(b["node"], []).append(b)
        left = []
        for n in seeking:
            below = n.below
            for b in by_node[n.first]:
                if below + b["size"] >= n.aim or b["high"] == n.high:
                    break
                below += b["size"]
            n.low, n.high, n.below = b["low"], b["high"], below
            if n.low < n.high:
                left.append(n)
            else:  # one place is left: its rows go to the side that brings the halves nearer their aims
                n.threshold = n.low + (n.aim - below > below + b["size"] - n.aim)
        seeking = left


def kd_tree(points: DataFrame, shards: int, dimensions: int) -> DataFrame:
    """``points`` (size, key0, key1, ...) with the shard of each: the tree grows a level at a time until its leaves have one shard, of like bytes each.

    The cuts of a tree of up to MOST_SHARDS leaves stand in one SQL expression; larger ones keep the leaf of each
    point in a checkpoint, and the cuts below it are small tables. Widths are told in shares of those of all points.
    """
    tops, depth, spans = [Node(0, shards)], 0, []
    while open_nodes := [n for top in tops for n in top.leaves() if n.shards > 1]:
        placed = located(points, tops, dimensions)
        keys = [f(f"key{d}").alias(f"{f.__name__}{d}") for d in range(dimensions) for f in (F.min, F.max)]
        stats = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("size"), *keys).collect()}
        sought = []
        for n in open_nodes:
            n_left = n.shards // 2
            if (r := stats.get(n.first)) is not None:
                ends = [(r[f"min{d}"], r[f"max{d}"]) for d in range(dimensions)]
                widths = [(high >> LOW) - (low >> LOW) for low, high in ends]
                spans = spans or [max(w, 1) for w in widths]
                n.dimension = max(range(dimensions), key=lambda d: widths[d] / spans[d])
                n.low, n.high = ends[n.dimension]
                n.below, n.aim = 0, r["size"] * n_left / n.shards
                sought.append(n)
        _medians(placed, sought, dimensions)
        for n in open_nodes:
            n_left = n.shards // 2
            n.left, n.right = Node(n.first, n_left), Node(n.first + n_left, n.shards - n_left)
        depth += 1
        leaves = [leaf for top in tops for leaf in top.leaves()]
        if depth >= DEPTH and 2 * len(leaves) > MOST_SHARDS:
            points, tops, depth = checkpointed(located(points, tops, dimensions)), [Node(n.first, n.shards) for n in leaves], 0
    return located(points, tops, dimensions).withColumn("shard", F.col("node").cast("int")).drop("node")


def sharded(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of ``docs`` (doc_id, text, lang, source).

    With ``target_bytes`` and no ``shards``, as many shards as bring leaves down to that size.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + COST).cast("long")
    points = docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        *(_hashed_value(F.col(c)).alias(f"value{k}") for k, c in enumerate(("source", "lang"))),
        _scaled_log(F.octet_length("text")).alias("value2"),
        # rows equal in id and text, and they alone, go by the files' layout: it does not matter which of them lies where
        F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - LOW + TIE), TIE).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - TIE)).alias("low"),
    )
    keys = (F.shiftleft(F.col(f"value{d}"), LOW).bitwiseOR(F.col("low")).alias(f"key{d}") for d in range(3))
    points = checkpointed(points.select("doc_id", "size", "text_crc32", *keys))
    if shards is None:
        total = points.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // max(1, target_bytes or 1)))
    routed = kd_tree(points, shards, 3)
    placed = routed.select("doc_id", "size", "text_crc32", "shard", (F.col("key2").bitwiseAND((1 << LOW) - 1)).alias("low"))
    ranked = globally_ranked(placed, ["shard", "low", "doc_id"], "rank")
    starts = ranked.groupBy("shard").agg(F.min("rank").alias("start"))  # one row a shard
    starts = F.broadcast(starts) if shards <= BROADCAST_SHARDS else starts
    return ranked.join(starts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("start")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of nearly equal bytes."""
    found = sharded(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
