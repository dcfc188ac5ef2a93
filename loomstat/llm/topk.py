"""Exact top-k inner products by block-at-a-time pruning.

Vectors are quantised to integers and dealt into chunks of bounded size, alike ones together: by
the signs of their most varied components around the means. A chunk, and within it each block of
neighbouring rows, keeps the maxima and minima of each term (component); a query's bound for it
is the sum over its terms of weight times maximum (or minimum, for a negative weight).

Each query is answered in the chunk with its best bound first. The k-th score found there goes
with it to the other chunks whose bounds reach it, and to these alone. In a chunk a query takes
the blocks in descending order of bounds and scores whole blocks through their forward index (the
block's rows) until the bound of its next block falls below its k-th score. Chunks and blocks
whose bound equals the k-th score are scored too, for ties. The best k of what all of a query's
chunks gave are kept by a window over the query.

Edge cases: vectors that are null or hold a null, NaN or infinite component take no part; of
vectors with different lengths the missing components count as zero; ties go to the smaller
vec_id, then to either of repeated rows; a query meets no row with its own vec_id; repeated
query rows are answered once; with fewer candidates than k all are returned; a score beyond 64
bits saturates; an empty table gives no rows; other columns, whatever their names, are not
carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, globally_ranked, shuffle_partitions, table

K = 5
SCALE = 256
#: Vectors of a chunk and of a block, and queries of a group.
CHUNK, BLOCK, GROUP = 16_384, 64, 4_096
#: Components at most by whose signs vectors are dealt, for so many more cells than chunks.
SIGNS, FINER = 60, 4
#: Bytes of chunk bounds at most that go to all tasks; beyond, queries go to all chunks.
MOST_BOUNDS = 256 << 20
#: Values up to this are exact in floating point.
EXACT = 1 << 53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vector: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    made = np.zeros((len(rows), width), np.int64)
    for at, row in enumerate(rows):
        made[at, : len(row)] = row
    return made


def _neighbours(values: np.ndarray, block: int) -> np.ndarray:
    """An order of the rows in which alike rows are neighbours: halves along the widest term, again and again."""
    done, todo = [], [np.arange(len(values))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            done.append(rows)
            continue
        some = values[rows]
        term = int(np.argmax(some.std(axis=0)))
        cut = max(1, len(rows) // block // 2) * block
        parts = np.argpartition(some[:, term], cut)
        todo += [rows[parts[cut:]], rows[parts[:cut]]]
    return np.concatenate(done)


def _bounds(queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The highest score that each query can have in each range of rows with these term minima and maxima."""
    return np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k highest scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array([sorted(range(len(s)), key=lambda c: (-s[c], i[c]))[:k] for s, i in zip(scores, ids)])
    return np.lexsort((ids, -scores), axis=1)[:, :k]


class Blocks:
    """A chunk's candidates in blocks, with each block's term maxima and minima."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, block: int):
        order = _neighbours(values.astype(np.float64), block)
        self.ids, self.values = ids[order], values[order]
        self.starts = np.arange(0, len(ids), block)
        self.ends = np.append(self.starts[1:], len(ids))
        self.most = np.maximum.reduceat(self.values, self.starts, axis=0)
        self.least = np.minimum.reduceat(self.values, self.starts, axis=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best scores and ids of each query, padded with the lowest score; those below the query's floor may lack."""
        floors = np.full(len(queries), -np.inf) if floors is None else floors
        bounds = _bounds(queries, self.least, self.most)
        order = np.argsort(-bounds, axis=1, kind="stable")
        n = len(queries)
        scores, found = np.full((n, k), -np.inf), np.full((n, k), _MOST, np.int64)
        if queries.dtype == object:
            scores = scores.astype(object)
        active = np.arange(n)
        for turn in range(len(self.starts)):
            blocks = order[active, turn]
            # else no later block can do better
            going = (bounds[active, blocks] >= scores[active, -1]) & (bounds[active, blocks] >= floors[active])
            active, blocks = active[going], blocks[going]
            if not len(active):
                break
            by_block = np.argsort(blocks, kind="stable")
            for some in np.split(by_block, np.flatnonzero(np.diff(blocks[by_block])) + 1):
                b, rows = blocks[some[0]], active[some]
                inside = slice(self.starts[b], self.ends[b])
                ids = self.ids[inside]
                got = queries[rows] @ self.values[inside].T
                if got.dtype == object:
                    got = np.where(ids[None, :] == query_ids[rows, None], -np.inf, got)
                else:
                    got[ids[None, :] == query_ids[rows, None]] = -np.inf
                every = np.concatenate([scores[rows], got], axis=1)
                every_id = np.concatenate([found[rows], np.broadcast_to(ids, got.shape)], axis=1)
                best = _best(every, every_id, k)
                scores[rows] = np.take_along_axis(every, best, 1)
                found[rows] = np.take_along_axis(every_id, best, 1)
        return scores, found


def _kind(width: int, *matrices: np.ndarray) -> type:
    """In what sums of products are exact: floating point, or Python's unbounded integers."""
    most = [max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0)))) for m in matrices]
    return np.float64 if width * math.prod(most) < EXACT else object


class Chunk:
    """A task's current chunk: candidates come first, then queries, which are answered in its blocks."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.made: tuple | None = None

    def add(self, part: pa.RecordBatch) -> None:
        rows = part.column("value").to_pylist()
        self.ids.append(part.column("vec_id").to_numpy())
        self.rows.append(_matrix(rows, max(map(len, rows), default=0)))

    def search(self, asked: pa.RecordBatch, k: int, block: int) -> pa.RecordBatch:
        """query, query_id, vec_id and score: the k best of the chunk for each of the queries."""
        rows, names = asked.column("value").to_pylist(), asked.column("query").to_numpy()
        query_ids = asked.column("vec_id").to_numpy()
        found = [np.zeros(0, np.int64)] * 4
        if self.ids:
            width = max([1, *map(len, rows), *(m.shape[1] for m in self.rows)])
            wanted = _matrix(rows, width)
            whole = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in self.rows]) if self.made is None or self.made[0] != width else self.made[1]
            kind = _kind(width, whole, wanted)
            if self.made is None or self.made[0] != width or self.made[2] != kind:
                self.made = (width, whole, kind, Blocks(np.concatenate(self.ids), whole.astype(kind), block))
            floors = asked.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
            floors = np.nextafter(np.where(np.isnan(floors), -np.inf, floors), -np.inf)  # never above the exact score
            scores, ids = self.made[3].search(query_ids, wanted.astype(kind), k, floors)
            real = np.flatnonzero((scores != -np.inf).ravel())
            flat = [min(max(int(s), _LEAST), _MOST) for s in scores.ravel()[real]]
            found = [np.repeat(names, k)[real], np.repeat(query_ids, k)[real], ids.ravel()[real], np.array(flat, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query", "query_id", "vec_id", "score"])


def chunk_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """chunk, kind and rows of each stretch of rows sorted by chunk and kind."""
    for batch in batches:
        place = batch.column("chunk").to_numpy() * 2 + batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
        for start, end in zip(cuts, cuts[1:]):
            if start < end:
                yield int(place[start]) // 2, int(place[start]) % 2, batch.slice(start, end - start)


def dealt(vectors: DataFrame, chunk: int = CHUNK, keys: tuple[str, ...] = ()) -> DataFrame:
    """``vectors`` (vec_id, value, keys) with chunk: ranges of ``chunk`` rows in an order by ``keys`` that keeps alike ones together. Checkpointed."""
    n = vectors.count()
    if n <= chunk:
        return checkpointed(vectors.select(*keys, "vec_id", "value", F.lit(0).cast("long").alias("chunk")))
    terms = vectors.select(F.posexplode("value").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread"))
    signs = min(SIGNS, (n // chunk * FINER).bit_length())
    picked = terms.orderBy(F.desc("spread"), "at").limit(signs).collect()  # one row for each of a bounded number of components
    bit = lambda r, k: F.when(F.coalesce(F.get("value", F.lit(r["at"])), F.lit(0)) > r["mean"], F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    cell = sum((bit(r, signs - 1 - k) for k, r in enumerate(picked)), F.lit(0).cast("long"))
    placed = vectors.withColumns({"cell": cell, "hash": F.xxhash64("vec_id", "value")})
    ranked = globally_ranked(placed, [*keys, "cell", "hash", "vec_id"], "rank")
    return ranked.select(*keys, "vec_id", "value", F.floor(F.col("rank") / chunk).cast("long").alias("chunk"))


def chunk_bounds(vectors: DataFrame) -> DataFrame:
    """chunk, and its term minima and maxima: least and most."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for name, own in frame.groupby("chunk")["value"]:
                values = _matrix(own, max(map(len, own)))
                short = np.array([len(v) for v in own]) < values.shape[1]
                least, most = values.min(axis=0), values.max(axis=0)
                yield pa.RecordBatch.from_pydict({"chunk": [name], "least": [least.tolist()], "most": [most.tolist()], "whole": [not short.any()]})

    parts = vectors.select("chunk", "value").mapInArrow(gathered, "chunk long, least array<long>, most array<long>, whole boolean")
    terms = parts.select("chunk", F.posexplode(F.arrays_zip("least", "most")).alias("at", "ends"))
    ends = terms.groupBy("chunk", "at").agg(F.min("ends.least").alias("least"), F.max("ends.most").alias("most"), F.count("*").alias("n"))
    n = parts.groupBy("chunk").agg(F.count("*").alias("parts"))
    # a component that some rows lack is zero there
    lacking = F.col("n") < F.col("parts")
    bounded = ends.join(n, "chunk").withColumns({"least": F.when(lacking, F.least("least", F.lit(0))).otherwise(F.col("least")), "most": F.when(lacking, F.greatest("most", F.lit(0))).otherwise(F.col("most"))})
    return bounded.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("at", "least", "most"))).alias("ends")).select("chunk", F.col("ends.least").alias("least"), F.col("ends.most").alias("most"))


def _reached(queries: DataFrame, bounds: pd.DataFrame, best_only: bool) -> DataFrame:
    """``queries`` (query, query_id, weights, floor, seed) with chunk: the one with the best bound, or all others whose bound reaches the floor."""
    names, width = bounds["chunk"].to_numpy(np.int64), max(map(len, bounds["least"]), default=1)
    least, most = _matrix(bounds["least"], width), _matrix(bounds["most"], width)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(2).to_pylist()
            own = _matrix(pd.Series(rows), max(width, *map(len, rows)))
            pad = lambda m: np.pad(m, ((0, 0), (0, own.shape[1] - width)))
            kind = _kind(own.shape[1], own, np.stack([least, most]))
            reach = _bounds(own.astype(kind), pad(least).astype(kind), pad(most).astype(kind)).astype(np.float64)
            if best_only:
                row, at = np.arange(len(rows)), np.argmax(reach, axis=1)
            else:
                floor = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                seed = batch.column(4).to_numpy(zero_copy_only=False)
                # as large as rounding beyond exact integers may be off
                slack = 0.0 if kind is np.float64 else np.abs(reach) * 1e-9
                row, at = np.nonzero(~(reach + slack < floor[:, None]) & (names[None, :] != seed[:, None]))
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(names[at], pa.int64())], [*batch.schema.names, "chunk"])

    schema = "query long, query_id long, weights array<long>, floor double, seed long, chunk long"
    return queries.select("query", "query_id", "weights", "floor", "seed").mapInArrow(sent, schema)


def _searched(vectors: DataFrame, wanted: DataFrame, k: int, block: int, group: int) -> DataFrame:
    """query, query_id, vec_id and score: the k best in each chunk that ``wanted`` names for a query.

    Each chunk is sent to one task, once, and all its queries stream past it in groups.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, current = None, Chunk()
        for chunk, kind, part in chunk_parts(batches):
            if chunk != name:
                name, current = chunk, Chunk()
            if kind == 0:
                current.add(part)
            else:
                for first in range(0, part.num_rows, group):
                    yield current.search(part.slice(first, group), k, block)

    none = F.lit(None)
    candidates = vectors.select("chunk", F.lit(0).alias("kind"), none.cast("long").alias("query"), "vec_id", "value", none.cast("double").alias("floor"))
    asked = wanted.select("chunk", F.lit(1).alias("kind"), "query", F.col("query_id").alias("vec_id"), F.col("weights").alias("value"), "floor")
    both = candidates.unionByName(asked).repartition(shuffle_partitions(vectors.sparkSession), "chunk")
    return both.sortWithinPartitions("chunk", "kind").mapInArrow(stream, "query long, query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, chunk: int = CHUNK, block: int = BLOCK, group: int = GROUP
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of ``vectors`` for each row of ``queries``.

    Both have vec_id long and value array<long>; rows with a null value or vec_id are left out.
    """
    vectors = dealt(vectors.select("vec_id", "value").dropna(), chunk)
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("value").alias("weights")).dropna().distinct()
    queries = checkpointed(queries.select(F.monotonically_increasing_id().alias("query"), "query_id", "weights", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("long").alias("seed")))
    terms = vectors.agg(F.max(F.size("value"))).first()[0]
    if terms is None or queries.isEmpty():
        return vectors.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    chunks = vectors.agg(F.max("chunk")).first()[0] + 1
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    if chunks == 1:
        found = _searched(vectors, queries.withColumn("chunk", F.lit(0).cast("long")), k, block, group)
    elif chunks * terms * 16 > MOST_BOUNDS:
        found = _searched(vectors, queries.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1)))), k, block, group)
    else:
        bounds = chunk_bounds(vectors).toPandas()  # at most MOST_BOUNDS
        seeded = checkpointed(_reached(queries, bounds, best_only=True))
        first = checkpointed(_searched(vectors, seeded, k, block, group))
        floors = first.groupBy("query").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n"))
        told = seeded.drop("floor", "seed").withColumnRenamed("chunk", "seed").join(floors, "query", "left")
        told = told.withColumn("floor", F.when(F.col("n") == k, F.col("least")).otherwise(float("-inf")))
        found = first.unionByName(_searched(vectors, _reached(told, bounds, best_only=False), k, block, group))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of embeddings for each row whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised().alias("value"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS value
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.value) + 1), lambda i: q.value[i] * c.value[i])) AS BIGINT) AS score
  FROM vectors q, vectors c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
