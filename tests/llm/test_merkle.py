"""The Merkle manifest against a plain version, and its parts."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from helpers import SCHEMA, documents, empty
from loomstat.llm import merkle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r, text) -> str:
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels(nodes: list[str]) -> list[list[str]]:
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][k : k + 3])) for k in range(0, len(found[-1]), 3)])
    return found


def siblings(tree: list[list[str]], pos: int) -> list[tuple[list[str], list[str]]]:
    found = []
    for level in tree[:-1]:
        first = pos // 3 * 3
        found.append((level[first:pos], level[pos + 1 : first + 3]))
        pos //= 3
    return found


def plain(rows) -> list[tuple]:
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append((r["doc_id"], leaf_of(r, r["text"]), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for leaves in by_source.values():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels([leaf for _, leaf, _ in by_source[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    found = []
    for k, s in enumerate(order):
        for pos, (doc_id, leaf, r) in enumerate(by_source[s]):
            path = siblings(trees[s], pos) + siblings(top, k)
            even = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 2 == 0
            folded = leaf_of(r, r["text"].replace("\n", "") if even and r["text"] is not None else r["text"])
            for left, right in path:
                folded = sha("".join(left) + folded + "".join(right))
            flat = [x for step in path for side in step for x in side]
            found.append((doc_id, leaf, trees[s][-1][0], top[-1][0], sha("".join(flat)), folded, folded == top[-1][0], flat))
    return found


def operator(docs, part):
    changed = F.when(merkle.id_crc("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    columns = {c: F.col(c) for c in merkle.COLUMNS}
    return merkle.manifest(docs, merkle.leaf_digest(columns), merkle.leaf_digest(columns | {"text": changed}), part=part)


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("part", [4, merkle.PART])
def test_awkward_documents(spark, part):
    docs = documents(spark)
    assert in_order(operator(docs, part)[1].collect()) == in_order(plain(docs.collect()))


@pytest.mark.parametrize(("rows", "sources", "part"), [(1, 1, 5), (2, 2, 5), (3, 1, 2), (60, 25, 7), (300, 2, 10)])
def test_shapes(spark, rows, sources, part, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(merkle, "STEP", 2)
    random.seed(rows)
    made = [(k * 7 % 1000, f"a\nb{k}" if k % 3 else None, None, f"s{random.randrange(sources)}", k) for k in range(rows)]
    docs = spark.createDataFrame(made, SCHEMA)
    nodes, proofs = operator(docs, part)
    assert in_order(proofs.collect()) == in_order(plain(docs.collect()))
    # the manifest's nodes hash up to the root
    by_place = {(r["tree"], r["level"], r["pos"]): r["digest"] for r in nodes.collect()}
    for (tree, level, pos), digest in by_place.items():
        if level:
            run = [by_place[tree, level - 1, p] for p in range(pos * 3, pos * 3 + 3) if (tree, level - 1, p) in by_place]
            assert digest == sha("".join(run))


def test_empty_table(spark):
    nodes, proofs = operator(empty(spark), 5)
    assert proofs.count() == 0 and nodes.count() == 0


def test_missing_nodes_are_needed_and_enough():
    for n in (1, 2, 3, 4, 9, 10, 28, 100):
        tree = levels([str(k) for k in range(n)])
        for first in range(n):
            for last in range(first, n, 3):
                asked = merkle.missing_nodes(first, last, n)
                known = {(level, p) for level in range(len(tree)) for p in range(-(-first // 3**level), len(tree[level])) if min((p + 1) * 3**level, n) - 1 <= last}
                assert len(set(asked)) == len(asked) and not known & set(asked)
                fetched = {c: tree[c[0]][c[1]] for c in asked}
                stretch = merkle.Stretch(first, tree[0][first : last + 1], n, fetched)
                assert stretch.top == tree[-1][0]
                for pos in {first, last}:
                    assert stretch.path(pos) == [("".join(a), "".join(b)) for a, b in siblings(tree, pos)]


def test_heights():
    for n in (1, 2, 3, 4, 9, 10, 27, 28, 3**12, 3**12 + 1):
        wanted, left = 0, n
        while left > 1:
            left, wanted = -(-left // 3), wanted + 1
        assert merkle.height(n) == wanted
