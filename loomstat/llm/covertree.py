"""Hard negatives by cover trees over norm-augmented candidates.

Vectors are quantised to integers and dealt, by label and alike ones together, into chunks of bounded
size. A chunk's candidates get one more component, which makes all their norms the chunk's largest;
then the nearer a candidate is to an anchor (with a zero there), the higher their inner product.
Over these points stands a cover tree: the points of a node lie within its level's covering radius
of its centre, and halving the radius from level to level gives its children. A node's covering radius and
the anchor's distance from its centre bound the inner products of all its points from both sides.

Each chunk is sent to one task, once, and anchors stream past it. They descend best bound first, all in
step: each takes its open node of highest bound, those that take one node together. A node is
skipped if its bounds lie outside all of an anchor's windows, or cannot beat what a window holds; points of
the nodes that stay are scored exactly. A first descent finds each anchor's positives, in chunks with
its label; the positives' scores give the windows of a second one, for the negatives. Chunks whose root
already lies outside an anchor's windows do not get the anchor.

Edge cases: rows with a null label or id, or a vector that is null or holds a null, NaN or infinite
component take no part; of vectors with different lengths the missing components count as zero;
ties go to the smaller vec_id, then to either of repeated rows; a row with the anchor's own vec_id is
none of its positives; repeated anchors are answered once; positives whose window is empty (as all of
negative score) and anchors without other rows of their label give no rows; a score beyond 64 bits
saturates; an empty table gives no rows; other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions, table
from .topk import EXACT, dealt, quantised

POSITIVES, NEGATIVES, LABELS = 5, 3, 10
#: The window of a positive's negatives, in hundredths of its score.
LOW, HIGH = 50, 95
#: Vectors of a chunk, points of a node that is not split, and anchors that descend in step.
CHUNK, LEAF, BATCH = 8192, 32, 512
#: The covering radius of a level, as a share of the one above.
SHRINK = 0.5
#: Bytes of chunk roots at most that go to all tasks; beyond, anchors go to all chunks.
MOST_ROOTS = 64 << 20
#: By how much of their size rounding may move a bound.
SLACK = 1e-9
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class CoverNode:
    """Points (places in the tree) within ``radius`` of a centre: ``own`` ones, which are scored when it is opened, or those of its children."""

    centre: int
    radius: float
    own: np.ndarray
    children: list[CoverNode] = field(default_factory=list)
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """From each point to each centre."""
    square = (points * points).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * points @ centres.T
    return np.sqrt(np.maximum(square, 0.0))


def _covered(points: np.ndarray, radius: float, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres among the points, each beyond ``radius`` of those before it, and for each point its nearest one."""
    centres, open_rows = [first], np.ones(len(points), bool)
    near, best = _distances(points, points[[first]])[:, 0], np.zeros(len(points), np.int64)
    open_rows &= near > radius
    while open_rows.any():
        # a block of open points at a time: those of it that others of it cover are no centres
        block = np.flatnonzero(open_rows)[:256]
        between = _distances(points[block], points[block])
        chosen: list[int] = []
        for k in range(len(block)):
            if not chosen or (between[k, chosen] > radius).all():
                chosen.append(k)
        new = block[chosen]
        to_new = _distances(points, points[new])
        nearest = to_new.argmin(1)
        distance = to_new[np.arange(len(points)), nearest]
        closer = distance < near
        best[closer] = nearest[closer] + len(centres)
        near = np.where(closer, distance, near)
        centres += new.tolist()
        open_rows &= near > radius
        open_rows[block] = False
    return np.array(centres), best


class CoverTree:
    """A cover tree over a chunk's candidates."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, leaf: int = LEAF):
        self.ids, self.labels, self.values = ids, labels, values
        plain = values.astype(np.float64)
        norms = (plain * plain).sum(1)
        self.most = float(norms.max())
        points = np.column_stack([plain, np.sqrt(np.maximum(self.most - norms, 0.0))])
        self.root = self._grown(points, leaf)

    def _grown(self, points: np.ndarray, leaf: int) -> CoverNode:
        """The tree over all points; nodes that wait for their children are in a list, so depth does not matter."""
        every = np.arange(len(points))
        made = CoverNode(0, float(_distances(points, points[[0]]).max()), every)
        waiting = [(made, made.radius * SHRINK)]
        while waiting:
            node, radius = waiting.pop()
            if len(node.own) <= leaf or node.radius <= SLACK * math.sqrt(self.most):
                continue
            rows, single = node.own, []
            within = points[rows]
            while True:  # a level on which the centre alone covers all has no node
                centres, nearest = _covered(within, radius, int(np.flatnonzero(rows == node.centre)[0]))
                if len(centres) > 1:
                    break
                radius *= SHRINK
            order = np.argsort(nearest, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(nearest[order])) + 1):
                if len(some) == 1:
                    single.append(rows[some[0]])
                    continue
                at = centres[nearest[some[0]]]
                child = CoverNode(int(rows[at]), float(_distances(within[some], within[[at]]).max()), rows[some])
                node.children.append(child)
                waiting.append((child, radius * SHRINK))
            node.own = np.array(single, np.int64)  # nodes of one point are points of their parent
            node.centres = np.array([c.centre for c in node.children], np.int64)
            node.radii = np.array([c.radius for c in node.children])
        return made

    def bounds(self, products: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the highest inner product that an anchor (of squared norm ``norms``) can have with points within ``radii`` of centres."""
        return product_bounds(products, norms, radii, self.most)

    def search(self, anchors: Anchors, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best scores and ids within each anchor's windows, padded; of candidates with the anchor's label (``same``) or with others."""
        n = len(anchors.ids)
        state = Held(anchors, k)
        heaps: list[list] = [[(0.0, 0, 0)] for _ in range(n)]  # -bound, number, place in the queue of that number
        queues: list[list[tuple[list[CoverNode], np.ndarray, np.ndarray]]] = [[([self.root], np.array([np.inf]), np.array([-np.inf]))] for _ in range(n)]
        active = list(range(n))
        while active:
            opened: dict[int, tuple[CoverNode, list[int]]] = {}
            going = []
            for row in active:
                node = self._next(heaps[row], queues[row], state, row)
                if node is not None:
                    opened.setdefault(id(node), (node, []))[1].append(row)
                    going.append(row)
            active = going
            for node, rows in opened.values():
                self._open(node, np.array(rows), anchors, state, same, heaps, queues)
        return state.scores, state.ids

    @staticmethod
    def _next(heap: list, queues: list, state: Held, row: int) -> CoverNode | None:
        """An anchor's open node of highest bound, if it may hold something."""
        while heap:
            _, number, at = heappop(heap)
            nodes, upper, lower = queues[number]
            if at + 1 < len(nodes):
                heappush(heap, (-upper[at + 1], number, at + 1))
            if upper[at] < state.floor[row]:
                heap.clear()  # no later one can do better
            elif state.wants(row, lower[at], upper[at]):
                return nodes[at]
        return None

    def _open(self, node: CoverNode, rows: np.ndarray, anchors: Anchors, state: Held, same: bool, heaps: list, queues: list) -> None:
        wanted = anchors.values[rows]
        if len(node.own):
            got = wanted @ self.values[node.own].T
            equal = self.labels[node.own][None, :] == anchors.labels[rows][:, None]
            fits = equal & (self.ids[node.own][None, :] != anchors.ids[rows][:, None]) if same else ~equal
            state.take(rows, got, self.ids[node.own], fits)
        if node.children:
            lower, upper = self.bounds((wanted @ self.values[node.centres].T).astype(np.float64), anchors.norms[rows], node.radii)
            order = np.argsort(-upper, axis=1, kind="stable")
            for k, row in enumerate(rows):
                some = order[k]
                heappush(heaps[row], (-upper[k, some[0]], len(queues[row]), 0))
                queues[row].append(([node.children[c] for c in some], upper[k, some], lower[k, some]))


def product_bounds(products: np.ndarray, norms: np.ndarray, radii: np.ndarray, most: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of inner products from those with centres: |a - c|^2 = |a|^2 + most - 2ac for all points c of augmented norm ``most``."""
    whole = norms[:, None] + most
    distance = np.sqrt(np.maximum(whole - 2 * products, 0.0))
    lower, upper = ((whole - d * d) / 2 for d in (distance + radii, np.maximum(distance - radii, 0.0)))
    return lower - SLACK * whole, upper + SLACK * whole


@dataclass
class Anchors:
    """Anchors with their windows: least and highest scores, a column for each window; unused ones are empty."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norms: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        plain = self.values.astype(np.float64)
        self.norms = (plain * plain).sum(1)


class Held:
    """The ``k`` best scores and ids found so far in each window of each anchor."""

    def __init__(self, anchors: Anchors, k: int):
        n, windows = anchors.low.shape
        self.k, self.low, self.high = k, anchors.low, anchors.high
        self.scores = np.full((n, windows, k), -np.inf, anchors.values.dtype)
        self.ids = np.full((n, windows, k), _MOST, np.int64)
        self.least = np.where(anchors.low <= anchors.high, anchors.low, np.inf).astype(np.float64)  # what a score must reach
        self.floor = self.least.min(1, initial=np.inf)
        self.top = anchors.high.astype(np.float64)

    def wants(self, row: int, lower: float, upper: float) -> bool:
        """Whether scores between the bounds may come to a window."""
        return bool(((upper >= self.least[row]) & (lower <= self.top[row])).any())

    def take(self, rows: np.ndarray, got: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Take those of the scores ``got`` (a row for each of ``rows``) that are among the best of a window."""
        for w in range(self.low.shape[1]):
            inside = fits & (got >= np.maximum(self.low[rows, w], self.scores[rows, w, -1])[:, None]) & (got <= self.high[rows, w, None])
            if not inside.any():
                continue
            some = np.where(inside, got, -np.inf)
            if some.shape[1] > self.k:  # no more than k, and what ties with the k-th
                inside &= some >= -np.partition(-some, self.k - 1, axis=1)[:, self.k - 1, None]
            own, at = np.nonzero(inside)
            touched = np.unique(own)
            place = np.searchsorted(touched, own)
            scores = np.concatenate([self.scores[rows[touched], w].ravel(), got[own, at]])
            every = np.concatenate([self.ids[rows[touched], w].ravel(), ids[at]])
            row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
            if scores.dtype == object:
                order = np.array(sorted(range(len(row)), key=lambda c: (row[c], -scores[c], every[c])))
            else:
                order = np.lexsort((every, -scores, row))
            starts = np.searchsorted(row[order], np.arange(len(touched)))
            best = order[starts[:, None] + np.arange(self.k)]
            self.scores[rows[touched], w], self.ids[rows[touched], w] = scores[best], every[best]
            kth = self.scores[rows[touched], w, -1].astype(np.float64)
            self.least[rows[touched], w] = np.maximum(self.least[rows[touched], w], kth)
        self.floor[rows] = self.least[rows].min(1, initial=np.inf)


def window(score: int) -> tuple[int, int]:
    """The least and the highest score of negatives of a positive."""
    return -(-LOW * score // 100), HIGH * score // 100


def _matrix(rows: list, width: int) -> np.ndarray:
    made = np.zeros((len(rows), width), np.int64)
    for at, row in enumerate(rows):
        made[at, : len(row)] = row
    return made


def _size(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.min(initial=0))), abs(int(matrix.max(initial=0))))


def _exact(*factors: int) -> type:
    """In what sums of so many products are exact: floating point, or Python's unbounded integers."""
    return np.float64 if math.prod(factors) < EXACT else object


class Chunk:
    """A task's current chunk: candidates come first, then anchors, which meet the tree over these."""

    def __init__(self, name: int):
        self.name, self.ids, self.labels, self.rows = name, [], [], []
        self.tree: CoverTree | None = None

    def add(self, ids: list, labels: list, rows: list) -> None:
        # as arrays: lists of Python integers take several times as much
        self.ids += ids
        self.labels += labels
        self.rows.append((_matrix(rows, max(map(len, rows), default=0)), [len(r) for r in rows]))

    def grown(self, anchor_width: int) -> CoverTree:
        width = max([anchor_width, *(m.shape[1] for m, _ in self.rows)])
        if self.tree is None or self.tree.values.shape[1] < width:
            values = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m, _ in self.rows])
            self.tree = CoverTree(np.array(self.ids, np.int64), np.array(self.labels, np.int64), values)
        return self.tree

    def root(self) -> list[float]:
        """The largest squared norm, the root's radius and its centre: all that routing needs."""
        tree = self.grown(0)
        return [tree.most, tree.root.radius, *tree.values[tree.root.centre].astype(np.float64).tolist()]

    def found(self, anchors: pa.RecordBatch, k: int, same: bool) -> Iterator[tuple]:
        """Rows of anchor, slot, vec_id and score."""
        names, ids, labels, rows, targets = (anchors.column(c).to_pylist() for c in ("anchor", "vec_id", "label", "value", "targets"))
        tree = self.grown(max(map(len, rows), default=0))
        wanted = _matrix(rows, tree.values.shape[1])
        kind = _exact(max(tree.values.shape[1], 1), _size(tree.values), _size(wanted))
        windows = [[(-np.inf, np.inf)] if same else [window(t) for t in own] for own in targets]
        most = max(map(len, windows), default=0)
        ends = np.array([[*own, *[(0, -1)] * (most - len(own))] for own in windows], dtype=kind).reshape(len(rows), most, 2)
        whole = tree.values
        tree.values = whole.astype(kind)
        scores, best = tree.search(Anchors(np.array(ids, np.int64), np.array(labels, np.int64), wanted.astype(kind), ends[:, :, 0], ends[:, :, 1]), k, same)
        tree.values = whole
        for row, slot, at in zip(*np.nonzero(scores > -np.inf)):
            yield names[row], int(slot), int(best[row, slot, at]), min(max(int(scores[row, slot, at]), _LEAST), _MOST)


_FOUND = "anchor long, slot int, vec_id long, score long, chunk long, root array<double>"


def _searched(vectors: DataFrame, wanted: DataFrame, k: int, same: bool, batch: int) -> DataFrame:
    """What each anchor of ``wanted`` (anchor, vec_id, label, value, targets, chunk) finds in its chunk of ``vectors``; and, if ``same``, each chunk's root."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Chunk | None = None

        def made(rows: list[tuple], root: list[float] | None = None) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)] if rows else [[], [], [], []]
            name, more = ([current.name], [root]) if root else ([], [])
            columns = [[None] * len(more) + c for c in columns]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))), pa.array(name + [None] * len(rows), pa.int64()), pa.array(more + [None] * len(rows), pa.list_(pa.float64()))],
                ["anchor", "slot", "vec_id", "score", "chunk", "root"],
            )

        for whole in batches:
            place = whole.column("chunk").to_numpy() * 2 + whole.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                part, name, kind = whole.slice(start, end - start), int(place[start]) // 2, int(place[start]) % 2
                if current is None or current.name != name:
                    if same and current is not None:
                        yield made([], current.root())
                    current = Chunk(name)
                if kind == 0:
                    current.add(*(part.column(c).to_pylist() for c in ("vec_id", "label", "value")))
                    continue
                for first in range(0, part.num_rows, batch):
                    yield made(list(current.found(part.slice(first, batch), k, same)))
        if same and current is not None:
            yield made([], current.root())

    none = F.lit(None)
    candidates = vectors.select("chunk", F.lit(0).alias("kind"), none.cast("long").alias("anchor"), "vec_id", "label", "value", none.cast("array<long>").alias("targets"))
    asked = wanted.select("chunk", F.lit(1).alias("kind"), "anchor", "vec_id", "label", "value", "targets")
    both = candidates.unionByName(asked).repartition(shuffle_partitions(vectors.sparkSession), "chunk")
    return both.sortWithinPartitions("chunk", "kind").mapInArrow(stream, _FOUND)


def _routed(anchors: DataFrame, roots: list, width: int) -> DataFrame:
    """``anchors`` with chunk: each whose root lies not outside all of the anchor's windows."""
    names = np.array([r["chunk"] for r in roots], np.int64)
    most, radii = (np.array([r["root"][k] for r in roots]) for k in (0, 1))
    centres = np.zeros((len(roots), width))
    for k, r in enumerate(roots):
        centres[k, : len(r["root"]) - 2] = r["root"][2:]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, targets = batch.column("value").to_pylist(), batch.column("targets").to_pylist()
            own = _matrix(rows, max(width, *map(len, rows))).astype(np.float64)
            products = own[:, :width] @ centres.T
            lower, upper = product_bounds(products, (own * own).sum(1), radii[None, :], most[None, :])
            reach = np.zeros(products.shape, bool)
            for k, some in enumerate(targets):
                for low, high in map(window, some):
                    if low <= high:
                        reach[k] |= (upper[k] >= low) & (lower[k] <= high)
            row, at = np.nonzero(reach)
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(names[at], pa.int64())], [*batch.schema.names, "chunk"])

    return anchors.mapInArrow(routed, "anchor long, vec_id long, label long, value array<long>, targets array<long>, chunk long")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, chunk: int = CHUNK, batch: int = BATCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each row of ``anchors``.

    Both have vec_id long, label long and value array<long>; rows with a null are left out.
    """
    columns = ["vec_id", "label", "value"]
    vectors = dealt(vectors.select(columns).dropna(), chunk, ("label",))
    anchors = anchors.select(columns).dropna().distinct()
    anchors = checkpointed(anchors.select(F.monotonically_increasing_id().alias("anchor"), *columns, F.lit(None).cast("array<long>").alias("targets")))
    of_label = vectors.select("label", "chunk").distinct()
    first = checkpointed(_searched(vectors, anchors.join(of_label, "label"), positives, True, batch))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    near = first.filter("root is null").withColumn("place", best("anchor")).filter(F.col("place") <= positives)
    near = near.select("anchor", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    scores = near.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("targets"))
    told = checkpointed(anchors.drop("targets").join(scores, "anchor").select("anchor", *columns, "targets"))
    roots = first.filter("root is not null").select("chunk", "root")
    count, width = roots.agg(F.count("*"), F.coalesce(F.max(F.size("root")), F.lit(2))).first()
    if count * width * 8 <= MOST_ROOTS:
        sent = _routed(told, roots.collect(), width - 2)
    else:
        sent = told.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    far = _searched(vectors, sent, negatives, False, batch).withColumn("rank", best("anchor", "slot")).filter(F.col("rank") <= negatives)
    far = far.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return far.join(near, ["anchor", "slot"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each row of embeddings whose vec_id is divisible by 50; a seventh of the labels are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.cast("long").alias("label"), quantised().alias("value"))
    return hard_negatives(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS value
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.value) + 1), lambda i: a.value[i] * c.value[i])) AS BIGINT) AS score
  FROM vectors a, vectors c WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
