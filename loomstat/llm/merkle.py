"""A Merkle manifest of a dataset, with an octopus multiproof for each partition of leaves.

Every row is a leaf: a hash of its columns. The leaves of a group (a source), in the order of their
keys, are hashed in runs of three, the results again, until one node is left, the subroot; the
subroots in the order of the groups likewise give the root. Interior nodes come from a few shuffles of
digests, six levels in each, all groups together, whatever their sizes.

Leaves are partitioned in stretches of like size of the whole order, so a large group has many
partitions and small groups share one. For each partition the minimal union of the node coordinates that
its leaves' proofs need and its own leaves do not give is told from its ends alone: at most two
on either side of each level of the trees at its ends, and as many of the tree of subroots. The
partition gets these digests once, derives all interiors that its leaves share, and expands the proof of each leaf from them.

Edge cases: a null column is hashed as ``-``, which no value is; a null group comes first; leaves
with one key go by their digests, so repeated rows each have a place and the tree is the same each
time; a group of one leaf has the leaf as its subroot, one group its subroot as the root; texts of
any length are hashed whole; an empty table gives no rows; other columns, whatever their names, are
not carried. A null key counts as the empty text where its checksum decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, globally_ranked, id_crc, table

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and levels that one shuffle of digests climbs.
ARITY, STEP = 3, 6
#: Leaves of a partition.
PART = 8192
#: Rows at most (of some 200 bytes) that are broadcast.
BROADCAST_ROWS = 100_000
#: The tree of subroots among those of groups, which count from 0.
TOP = -1

HEIGHTS = [ARITY**k for k in range(40)]


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    return sum(p < n for p in HEIGHTS)


def _height(n: Column) -> Column:
    return F.size(F.filter(F.lit(HEIGHTS), lambda p: p < n))


def leaf_digest(columns: dict[str, Column] | Iterable[str]) -> Column:
    """The hash of a row: of each column its byte count, a colon and the value, or a hyphen if null."""
    columns = list(columns.values()) if isinstance(columns, dict) else [F.col(c) for c in columns]
    texts = [c.cast("string") for c in columns]
    fields = (F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)
    return F.sha2(F.concat(*fields), 256)


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def climbed(nodes: DataFrame, base: int) -> DataFrame:
    """The nodes (tree, level, pos, digest, n) of up to STEP levels above ``nodes`` (tree, pos, digest, n), which are of level ``base``."""
    wide = ARITY**STEP
    group = nodes.groupBy("tree", "n", F.expr(f"pos div {wide}").alias("chunk"))
    level = group.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda c: c["digest"]).alias("a0"))
    for k in range(1, STEP + 1):
        below = F.col(f"a{k - 1}")
        runs = F.sequence(F.lit(0), F.expr(f"(size(a{k - 1}) - 1) div {ARITY}"))
        # names each level, so that none is computed twice
        level = level.withColumn(f"a{k}", F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * ARITY + 1, ARITY), ""), 256)))  # noqa: B023
    parts = [F.struct(F.lit(base + k).alias("level"), (F.col("chunk") * ARITY ** (STEP - k)).alias("first"), F.col(f"a{k}").alias("digests")) for k in range(1, STEP + 1)]
    levels = level.select("tree", "n", F.inline(F.array(*parts))).filter(F.col("level") <= _height(F.col("n")))
    return levels.select("tree", "level", "n", "first", F.posexplode("digests").alias("at", "digest")).select("tree", "level", (F.col("first") + F.col("at")).alias("pos"), "digest", "n")


def interiors(leaves: DataFrame, most: int) -> DataFrame:
    """All interior nodes (tree, level, pos, digest, n) over ``leaves`` (tree, pos, digest, n), of trees of up to ``most`` leaves. Checkpointed."""
    spark = leaves.sparkSession
    found = spark.createDataFrame([], "tree long, level int, pos long, digest string, n long")
    level, base = leaves, 0
    while base < height(most):
        step = checkpointed(climbed(level, base))
        found = found.unionByName(step)
        base += STEP
        level = step.filter(F.col("level") == base).filter(_height(F.col("n")) > base).select("tree", "pos", "digest", "n")
    return found


def missing_nodes(first: int, last: int, n: int) -> list[tuple[int, int]]:
    """The coordinates (level, pos) that the proofs of leaves ``first`` to ``last``, of ``n``, need and these leaves do not give."""
    found = []
    for level in range(height(n)):
        left, right = first // ARITY, last // ARITY
        found += [(level, p) for p in range(left * ARITY, first)]
        found += [(level, p) for p in range(last + 1, min((right + 1) * ARITY, n))]
        first, last, n = left, right, -(-n // ARITY)
    return found


def _hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Stretch:
    """Neighbouring leaves of one tree, with all that their proofs need: for each node above or beside them, what stands left and right of it in its run."""

    def __init__(self, first: int, digests: list[str], n: int, fetched: dict[tuple[int, int], str]):
        self.first, self.sides = first, []
        last = first + len(digests) - 1
        for level in range(height(n)):
            left, right = first // ARITY, last // ARITY
            ends = range(left * ARITY, first), range(last + 1, min((right + 1) * ARITY, n))
            before, after = ([fetched[level, p] for p in some] for some in ends)
            whole = before + digests + after
            runs = [whole[k : k + ARITY] for k in range(0, len(whole), ARITY)]
            self.sides.append((left * ARITY, [("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))]))
            digests = [_hashed("".join(run)) for run in runs]
            first, last, n = left, right, -(-n // ARITY)
        (self.top,) = digests

    def path(self, pos: int) -> list[tuple[str, str]]:
        """What stands left and right of a leaf and of each node above it, level by level."""
        steps = []
        for first, sides in self.sides:
            steps.append(sides[pos - first])
            pos //= ARITY
        return steps


def expanded(leaves: pa.Table, fetched: pa.Table, n_trees: int, with_siblings: bool) -> pa.Table:
    """The proofs of a partition's leaves (tree, pos, n, key, leaf, tampered) from their own digests and those ``fetched`` (tree, level, pos, digest)."""
    leaves = leaves.sort_by([("tree", "ascending"), ("pos", "ascending")])
    known: dict[int, dict[tuple[int, int], str]] = {}
    for tree, level, pos, digest in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "pos", "digest"))):
        known.setdefault(tree, {})[level, pos] = digest
    trees, places, sizes, digests, tampered = (leaves[c].to_pylist() for c in ("tree", "pos", "n", "leaf", "tampered"))
    starts = [k for k in range(len(trees)) if k == 0 or trees[k] != trees[k - 1]]
    own = [Stretch(places[a], digests[a:b], sizes[a], known.get(trees[a], {})) for a, b in zip(starts, [*starts[1:], len(trees)])]
    above = Stretch(trees[0], [stretch.top for stretch in own], n_trees, known.get(TOP, {}))
    tops, proofs, folded, siblings = [], [], [], []
    at = -1
    for k, leaf in enumerate(tampered):
        if at + 1 < len(starts) and starts[at + 1] == k:
            at += 1
            rest = above.path(trees[k])
        steps = own[at].path(places[k]) + rest
        for left, right in steps:
            leaf = _hashed(left + leaf + right)
        folded.append(leaf)
        joined = "".join([side for step in steps for side in step])
        proofs.append(_hashed(joined))
        tops.append(own[at].top)
        if with_siblings:
            siblings.append([joined[i : i + 64] for i in range(0, len(joined), 64)])
    made = {"key": leaves["key"], "leaf": leaves["leaf"], "subroot": tops, "root": [above.top] * len(tops), "proof_sha256": proofs, "folded_root": folded, "verified": [f == above.top for f in folded]}
    if with_siblings:
        made["siblings"] = pa.array(siblings, pa.list_(pa.string()))
    return pa.table(made)


def manifest(docs: DataFrame, leaf: Column, tampered: Column | None = None, key: str = "doc_id", group: str = "source", with_siblings: bool = True, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trees over ``docs``, and the proof of each row.

    ``leaf`` is a row's digest, ``tampered`` the digest that is folded along its proof (the same if not given). Nodes:
    group, tree (the place of the group, -1 for the tree of subroots), level, pos, digest. Proofs: the key, leaf,
    subroot, root, proof_sha256, folded_root, verified and, ``with_siblings``, the proof itself: the siblings' digests,
    level by level, left to right.
    """
    leaves = checkpointed(docs.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf.alias("leaf"), (leaf if tampered is None else tampered).alias("tampered")))
    ranked = globally_ranked(leaves, ["grp", "key", "leaf"], "rank")
    spans = ranked.groupBy("grp").agg(F.min("rank").alias("start"), F.count("*").alias("n"))
    spans = globally_ranked(spans, ["grp"], "tree")
    n_trees, n_leaves, most = spans.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    n_parts = -(-n_leaves // part)
    parts = F.sequence(F.expr(f"start div {part}"), F.expr(f"(start + n - 1) div {part}"))
    by_part = spans.select("grp", "tree", "start", "n", F.explode(parts).alias("part"))
    placed = ranked.withColumn("part", F.expr(f"rank div {part}")).alias("a").join(
        _spread(by_part, n_trees + n_parts).alias("b"), F.expr("a.part = b.part and a.grp <=> b.grp")
    ).select("a.grp", "a.part", "tree", (F.col("rank") - F.col("start")).alias("pos"), "n", "key", "leaf", "tampered")

    digests = placed.select("tree", "pos", F.col("leaf").alias("digest"), "n")
    inner = interiors(digests, most)
    ends = inner.filter(F.col("level") == _height(F.col("n"))).unionByName(digests.filter("n = 1").withColumn("level", F.lit(0)))
    subroots = checkpointed(ends.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(n_trees).cast("long").alias("n")))
    nodes = digests.withColumn("level", F.lit(0)).unionByName(inner).unionByName(subroots.withColumn("level", F.lit(0))).unionByName(interiors(subroots, n_trees))

    edge = f"part * {part} - start"
    own = by_part.select("part", "tree", F.expr(f"greatest({edge}, 0)").alias("first"), F.expr(f"least({edge} + {part}, n) - 1").alias("last"), "n")
    tops = own.groupBy("part").agg(F.min("tree").alias("first"), F.max("tree").alias("last")).select("part", F.lit(TOP).cast("long").alias("tree"), "first", "last", F.lit(n_trees).cast("long").alias("n"))

    def octopus(frames):
        for frame in frames:
            rows = [(a, tree, level, pos) for a, tree, first, last, n in frame.itertuples(index=False) for level, pos in missing_nodes(first, last, n)]
            yield pd.DataFrame(rows, columns=["part", "tree", "level", "pos"])

    asked = own.unionByName(tops).mapInPandas(octopus, "part long, tree long, level int, pos long")
    # a partition asks for so many at most: on either side of each level of the trees at its ends and of the top tree
    few = n_parts * 2 * (ARITY - 1) * (2 * height(most) + height(n_trees))
    fetched = _spread(asked, few).join(nodes.select("tree", "level", "pos", "digest"), ["tree", "level", "pos"])

    key_type = docs.schema[key].dataType.simpleString()
    schema = f"key {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", siblings array<string>" if with_siblings else "")
    proofs = placed.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(lambda a, b: expanded(a, b, n_trees, with_siblings), schema)
    named = nodes.join(_spread(spans.select("grp", "tree"), n_trees), "tree", "left").select(F.col("grp").alias(group), "tree", "level", "pos", "digest")
    return named, proofs.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, folded from texts without line ends where 2 divides the checksum of the id."""
    docs = table(spark, sf_dir, "documents")
    changed = F.when(id_crc("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    columns = {c: F.col(c) for c in COLUMNS}
    return manifest(docs, leaf_digest(columns), leaf_digest(columns | {"text": changed}), with_siblings=False)[1]


# the checksum by its definition: each byte, then eight shifts
ORACLE_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, lang, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    replace(text, chr(10), '') AS flat,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1),
      lambda i: [ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc & 1 = 1 THEN sha256(head || coalesce(strlen(flat) || ':' || flat, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS changed
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM hashed),
nodes(tree, level, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3),
tops(level, pos, digest, n) AS (
  SELECT 0, tree, digest, count(*) OVER () FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM tops WHERE n > 1 GROUP BY level, pos // 3),
every AS (
  SELECT tree, level, pos, digest FROM nodes WHERE n > 1 UNION ALL SELECT -1, level, pos, digest FROM tops WHERE n > 1),
sides AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS behind
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 GROUP BY ALL),
steps AS (
  SELECT l.doc_id, l.leaf, s.level AS step, before, behind
  FROM leaves l JOIN sides s ON s.tree = l.tree AND s.pos = l.pos // CAST(3 ** s.level AS BIGINT)
  UNION ALL
  SELECT l.doc_id, l.leaf, 1000 + s.level, before, behind FROM leaves l JOIN sides s ON s.tree = -1 AND s.pos = l.tree // CAST(3 ** s.level AS BIGINT)),
proofs AS (
  SELECT doc_id, leaf, sha256(string_agg(before || behind, '' ORDER BY step)) AS proof_sha256,
    list([before, behind] ORDER BY step) AS path FROM steps GROUP BY doc_id, leaf),
folds AS (
  SELECT l.doc_id, l.leaf, l.tree, p.proof_sha256,
    list_reduce(list_prepend([l.changed, ''], p.path), lambda a, x: [sha256(x[1] || a[1] || x[2]), ''])[1] AS folded_root
  FROM leaves l JOIN proofs p ON p.doc_id IS NOT DISTINCT FROM l.doc_id AND p.leaf = l.leaf)
SELECT f.doc_id, f.leaf, s.digest AS subroot, r.digest AS root, f.proof_sha256, f.folded_root, f.folded_root = r.digest AS verified
FROM folds f JOIN nodes s ON s.tree = f.tree AND s.n = 1, (SELECT digest FROM tops WHERE n = 1) r
"""
