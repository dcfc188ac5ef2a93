"""Near-dedup at a given similarity of shingle sets, for whole documents with all their columns.

SimHash by ball hashing proposes texts whose fingerprints lie within the radius: copies that are
all but equal. Most copies at 0.8 lie further apart, so an exact similarity join by prefixes
proposes the rest: in any one order of all shingles, two texts of similarity ``t`` share one of the
first ``n - ceil(t * n) + 1`` of each one's ``n`` shingles, and the first that they share lies so
far to the front that enough can follow it (position filter). So each text is posted under the
shingles of its prefix, and those that meet under one and fit by size and place are candidates.
Shingles run from rare to common, as counted in a share of the texts. Only speed depends on
these counts.

Large groups of copies would make a pair of each two members. So under each shingle a text is
compared with its next ``WIDTH`` neighbours only, in order of size. Under those with more texts,
what was linked meanwhile need not be compared any more; where what is left comes to few
pairs a text, all of them are compared, else more neighbours, and so on, until every pair that can
be similar was compared or lies within one group. Crowded shingles are dealt to several tasks.

Candidates are ruled out by the parities of their shingles in a bitmap, where these differ in
more places than similar sets do, and else verified on all shingle hashes (64 bits) of both texts,
which are made anew for these only; verified pairs are links. Equal texts are one node each from
the start, so groups of exact copies cost nothing. Nodes are 64-bit hashes of texts.

Edge cases: as in ``simhash``: null, empty and blank texts are all alike; fewer words than a
shingle has make one shingle; a null doc_id comes last in its group; of rows equal in doc_id
and text one stays, by a hash of their other columns; an empty table gives no rows; all columns of the input are kept, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import checkpointed, distinct_rows, kept, released, row_key, strides, text_key
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Bits by which the fingerprints of texts compared in the first place differ at most.
RADIUS = 2
#: One in so many texts is counted to tell common shingles; and those at most that are told.
COUNTED, COMMON = 16, 1 << 17
#: Neighbours under a shingle that a text is compared with in the first round, and times as many in each further one.
WIDTH, WIDER = 32, 32
#: Texts under a shingle that meet in one task.
PART = 1 << 17
#: Texts or shingles at most that are broadcast to be looked up; for more, all are shuffled.
MOST_BROADCAST = 1 << 20
#: Pairs handed on in one batch.
PAIRS = 1 << 16
#: What rounding may take from a bound.
SLACK = 1e-6

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_LONGS = (pa.list_(pa.int64()), "array<long>")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit of ``x`` over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; of all words, if there are fewer."""
    width = max(1, min(width, len(words)))
    n = len(words) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        total = _mixed(total + words[k : k + n] * _ODD[k % len(_ODD)])
    return total


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    from xxhash import xxh64_intdigest

    split = text.lower().split()
    words = np.fromiter(map(xxh64_intdigest, split), np.uint64, len(split))
    return np.unique(_runs(words, shingle)) if len(words) else np.zeros(1, np.uint64)


def prefix(hashes: np.ndarray, common: np.ndarray, times: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The part of a text's shingles, rare ones first, of which each similar text shares one. ``common`` is in order."""
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        weight = np.where(common[at] == hashes, times[at], 0)
        if weight.any():
            hashes = hashes[np.argsort(weight, kind="stable")]
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - SLACK) + 1]


def parities(hashes: np.ndarray) -> bytes:
    """A bitmap of two to four bits a shingle: whether an odd number of shingles falls on each."""
    size = 1 << max(8, (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def difference(a: bytes, b: bytes) -> int:
    """The least number of shingles by which two sets with these parities differ."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def _mapped(texts: DataFrame, made, columns: dict[str, tuple[pa.DataType, str]]) -> DataFrame:
    """node and what ``made`` gives, a tuple for each text, of ``texts`` (node, text)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("fingerprints", dict)
        for batch in batches:
            for first, some in strides(batch.column(1)):
                found = list(zip(*(made(text or b"") for text in some)))
                arrays = [pa.array(values, kind) for values, (kind, _) in zip(found, columns.values())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), *arrays], ["node", *columns])

    schema = ", ".join(["node long", *(f"{name} {kind}" for name, (_, kind) in columns.items())])
    return texts.select("node", F.col("text").cast("binary")).mapInArrow(mapped, schema)


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that come most often in a share of the texts, in order, and in how many texts each."""
    counted = texts.filter(F.pmod("node", F.lit(COUNTED)) == 0).dropDuplicates(["node"])
    own = _mapped(counted, lambda text: (shingles(text, shingle).view(np.int64),), {"own": _LONGS})
    times = own.select(F.explode("own").alias("shingle")).groupBy("shingle").count().filter("count > 1")
    found = times.orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    common = found["shingle"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(common)
    return common[order], found["count"].to_numpy().astype(np.int32)[order]


def summaries(texts: DataFrame, common: np.ndarray, times: np.ndarray, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """node, size, fp (fingerprint), bits (parities) and prefix of each node of ``texts`` (node, text)."""

    def made(text: bytes) -> tuple:
        own = shingles(text, shingle)
        return len(own), simhash.majority(own), parities(own), prefix(own, common, times, similarity).view(np.int64)

    columns = {"size": (pa.int32(), "int"), "fp": (pa.int64(), "long"), "bits": (pa.binary(), "binary"), "prefix": _LONGS}
    return _mapped(texts, made, columns).dropDuplicates(["node"])


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def ball(told: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints are equal or, by ball hashing, within ``radius``; each chain of these is connected."""
    first = checkpointed(told.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")))
    equal = told.join(first.filter("first < last"), "fp").filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    end = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"node_{name}"))
    near = simhash.links(first.select("fp"), radius).join(end("a"), "a").join(end("b"), "b").select(*_ordered("node_a", "node_b"))
    return equal.unionByName(near)


def _posted(told: DataFrame) -> DataFrame:
    """shingle, size, at (its place) and node of each text under each shingle of its prefix."""
    return told.select(F.posexplode("prefix").alias("at", "shingle"), "size", "node")


def _most(size: np.ndarray, at: np.ndarray, similarity: float) -> np.ndarray:
    """The size of another text up to which what follows in both is enough."""
    return np.floor((1 + similarity) / similarity * (size - at) - size + SLACK).astype(np.int64)


def _batched(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches of the pairs, each pair in order and once a batch."""

    def batch_of(held: list) -> pa.RecordBatch:
        x, y = (np.concatenate(c) for c in zip(*held))
        ends = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], ["a", "b"])

    held, total = [], 0
    for pair in pairs:
        held.append(pair)
        total += len(pair[0])
        if total >= PAIRS:
            yield batch_of(held)
            held, total = [], 0
    if total:
        yield batch_of(held)


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in names]


def neighbours(dealt: DataFrame, width: int, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of ``dealt`` (shingle, part, ...) which can be similar, of different roots (if told), among each one's next ``width`` of its part.

    Besides, with null as b, each shingle under which more than these may be left to compare.
    A task holds a batch and ``width`` rows.
    """
    root = "root" if "root" in dealt.columns else "node"

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("shingle", "part", "size", "at", "node", root)
        tail: list[np.ndarray] = [np.zeros(0, np.int64)] * len(names)
        seen = [0, 0, 0]  # of the last part so far: texts, least and greatest root
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _columns(batch, names)
            begin, columns = len(tail[0]), [np.concatenate(c) for c in zip(tail, new)]
            key, part, size, at, node, top = columns
            most = _most(size, at, similarity)

            def near(begin=begin, key=key, part=part, size=size, most=most, node=node, top=top) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for step in range(1, width + 1):
                    other = np.arange(max(begin, step), len(key))
                    other = other[(key[other - step] == key[other]) & (part[other - step] == part[other])]
                    if not len(other):
                        break
                    left = other - step
                    fit = (size[other] <= most[left]) & (size[left] <= most[other]) & (top[left] != top[other])
                    yield node[left[fit]], node[other[fit]]

            yield from _batched(near())
            key, part, top = new[0], new[1], new[5]
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            counts = np.diff(np.r_[starts, len(key)])
            low, high = np.minimum.reduceat(top, starts), np.maximum.reduceat(top, starts)
            if begin and tail[0][-1] == key[0] and tail[1][-1] == part[0]:  # the last part goes on
                counts[0] += seen[0]
                low[0], high[0] = min(low[0], seen[1]), max(high[0], seen[2])
            # the last one is told when it is more, even if it goes on
            left_over = np.unique(key[starts[(counts > width + 1) & (low != high)]])
            if len(left_over):
                yield pa.RecordBatch.from_arrays([pa.array(left_over), pa.nulls(len(left_over), pa.int64())], ["a", "b"])
            seen = [counts[-1], low[-1], high[-1]]
            same = np.flatnonzero((columns[0] == key[-1]) & (columns[1] == part[-1]))[-width:]
            tail = [c[same] for c in columns]

    placed = dealt.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "size", "node")
    return placed.mapInArrow(paired, "a long, b long").distinct()


def meetings(celled: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All pairs (a, b) of ``celled`` which can be similar and are to meet: in cells from 0 on inner texts with others, below 0 others of different roots."""

    def of_cell(x: int, inner: np.ndarray, size: np.ndarray, at: np.ndarray, node: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        most, own = _most(size, at, similarity), inner.astype(bool)
        if x >= 0:
            inner_size, inner_most, inner_node = size[own], most[own], node[own]
            for n, m, k in zip(size[~own], most[~own], node[~own]):
                upto = np.searchsorted(inner_size, m, "right")  # in order of size
                fit = inner_node[:upto][inner_most[:upto] >= n]
                yield np.full(len(fit), k), fit
            return
        left, step = np.arange(len(node)), 1
        while len(left := left[left + step < len(node)]):
            left = left[size[left + step] <= most[left]]  # later ones are larger
            other = left + step
            fit = (size[left] <= most[other]) & (root[left] != root[other])
            yield node[left[fit]], node[other[fit]]
            step += 1

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("shingle", "x", "y", "inner", "size", "at", "node", "root")

        def found(parts: list[list[np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if parts:
                key, x, y, *rest = (np.concatenate(c) for c in zip(*parts))
                cuts = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
                for start, end in zip([0, *cuts], [*cuts, len(key)]):
                    yield from of_cell(int(x[start]), *(c[start:end] for c in rest))

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _columns(batch, names)
            apart = (columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1])
            last = int(apart.sum())  # where the batch's last cell begins
            if last or (held and any(held[-1][k][-1] != columns[k][0] for k in range(3))):
                yield from _batched(found([*held, [c[:last] for c in columns]]))
                held = []
            held.append([c[last:] for c in columns])
        yield from _batched(found(held))

    placed = celled.repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y", "size", "node")
    return placed.mapInArrow(paired, "a long, b long").distinct()


def _among(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``few``, which is checkpointed: broadcast only when its rows are counted and few."""
    return rows.join(F.broadcast(few) if few.count() <= MOST_BROADCAST else few, key, "left_semi")


def further(told: DataFrame, stars: DataFrame, crowded: DataFrame, width: int, turn: int, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Pairs of a further round under ``crowded`` shingles, and the shingles that are left after it.

    Where no more than ``width`` pairs a text are left, all of them: the shingle's largest root (inner texts) meets
    the others, and these meet each other, in blocks of at most PART texts. Elsewhere ``width`` neighbours.
    """
    roots = stars.select(F.col("child").alias("node"), F.col("parent").alias("root"))
    posted = _among(_posted(told), crowded, "shingle").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = posted.groupBy("shingle", "root").agg(F.count("*").alias("n"))
    tally = by_root.groupBy("shingle").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("chief"))
    others = F.col("all") - F.col("most")
    few_pairs = F.col("most") * others + others * others / 2 <= F.col("all") * width
    tally = checkpointed(tally.withColumn("others", others).withColumn("closing", few_pairs).filter("others > 0"))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / PART), F.lit(1)).cast("int")
    met = posted.join(tally, "shingle")
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(turn)), n).cast("int")
    inner = F.col("root") == F.col("chief")
    cells = met.filter("closing").withColumns({"inner": inner.cast("int"), "p": blocks("most"), "q": blocks("others")})
    cells = cells.withColumn("own", F.when(inner, block(F.col("p"))).otherwise(block(F.col("q"))))
    every = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    cell = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    with_inner, own = every("p", lambda i: cell(i, F.col("own"))), F.col("own")
    with_others = every("q", lambda k: cell(-1 - F.least(own, k), F.greatest(own, k)))
    celled = cells.select("shingle", "inner", "size", "at", "node", "root", F.inline(F.when(inner, every("q", lambda j: cell(own, j))).otherwise(F.concat(with_inner, with_others))))
    dealt = met.filter("not closing").withColumn("part", block(blocks("all")))
    pairs = meetings(celled, similarity).unionByName(neighbours(dealt, width, similarity).filter("b is not null"))
    return pairs, tally.filter("not closing").select("shingle")


def _possible(pairs: DataFrame, told: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose parities do not rule them out."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = np.floor((1 - similarity) / (1 + similarity) * sizes + SLACK).tolist()
            keep = [difference(x.as_py(), y.as_py()) <= m for x, y, m in zip(batch.column(4), batch.column(5), most)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    own = lambda end: told.select(F.col("node").alias(end), F.col("size").cast("long").alias(f"size_{end}"), F.col("bits").alias(f"bits_{end}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b")
    return both.mapInArrow(passed, "a long, b long")


def verified(pairs: DataFrame, told: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts in ``texts`` (node, text) share ``similarity`` of all their shingles."""
    near = checkpointed(_possible(pairs, told, similarity))
    ends = checkpointed(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    released(texts.sparkSession)  # what the pairs were found with
    asked = _among(texts, ends, "node")
    sets = _mapped(asked, lambda text: (shingles(text, shingle).tobytes(),), {"own": (pa.binary(), "binary")}).dropDuplicates(["node"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(shared >= similarity * (len(both) - shared) - SLACK)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    own = lambda end: sets.select(F.col("node").alias(end), F.col("own").alias(f"own_{end}"))
    both = near.join(own("a"), "a").join(own("b"), "b").select("a", "b", "own_a", "own_b")
    return both.mapInArrow(compared, "a long, b long")


def groups(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(child, parent) for each linked node of ``texts`` (node, text) but the smallest of its component."""
    spark = texts.sparkSession
    common, times = _common(texts, shingle)
    told = checkpointed(summaries(texts, common, times, shingle, similarity))
    posted, part = _posted(told), F.lit(0)
    hot = np.flatnonzero(times > PART // COUNTED)
    if len(hot):  # known beforehand: dealt to several parts at once
        parts = spark.createDataFrame(pa.table({"shingle": common[hot].view(np.int64), "parts": -(-times[hot].astype(np.int64) * COUNTED // PART)}))
        posted = posted.join(F.broadcast(parts), "shingle", "left")
        part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0))
    found = checkpointed(neighbours(posted.withColumn("part", part.cast("int")), WIDTH, similarity))
    released(spark)
    crowded = found.filter("b is null").select(F.col("a").alias("shingle"))
    if len(hot):
        crowded = crowded.union(parts.select("shingle")).distinct()
    pairs = checkpointed(ball(told, radius).union(found.filter("b is not null")).distinct())
    tested, width, turn = pairs, WIDTH, 0
    links = verified(pairs, told, texts, shingle, similarity)
    while True:
        stars = components(links)
        if crowded.isEmpty():
            return stars
        width, turn = WIDER * width, turn + 1
        pairs, crowded = further(told, stars, crowded, width, turn, similarity)
        pairs = checkpointed(pairs.join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        links = stars.toDF("a", "b").union(verified(pairs, told, texts, shingle, similarity))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (nulls last), all its columns kept."""
    node = text_key().alias("node")
    stars = groups(docs.select(node, "text"), shingle, similarity, radius).select(F.col("child").alias("node"), F.col("parent").alias("root"))
    released(docs.sparkSession)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "node")).alias("first")
    # the first document of each text, then of each group of texts: both minima are combined before they are shuffled
    texts = docs.select("doc_id", row_key(docs).alias("row_key"), node).groupBy("node").agg(first)
    chosen = texts.join(stars, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return distinct_rows(docs, chosen.select("first.row_key", "first.node")).select(*docs.columns)
