"""Hard negatives against brute force, and the cover tree's bounds."""

import random

import numpy as np
import pytest

from loomstat.llm import covertree
from loomstat.llm.covertree import Anchors, CoverTree, hard_negatives

SCHEMA = "vec_id long, label long, value array<long>, rank int, score string"


def plain(rows, anchors):
    rows = [r for r in rows if None not in (r[0], r[1], r[2])]
    anchors = {(a[0], a[1], tuple(a[2])) for a in anchors if None not in (a[0], a[1], a[2])}
    product = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1)
    found = []
    for anchor, label, value in anchors:
        scored = sorted(((-product(value, r[2]), r[0], r[1]) for r in rows))
        near = [(i, -s) for s, i, own in scored if own == label and i != anchor][:5]
        for positive, score in near:
            inside = [(i, -s) for s, i, own in scored if own != label and 50 * score <= -100 * s <= 95 * score][:3]
            found += [(anchor, positive, k + 1, i, score, s) for k, (i, s) in enumerate(inside)]
    return sorted(found)


def rows_of(kind: str, n: int, width: int = 6):
    random.seed(f"{kind}{n}")
    some = np.random.default_rng(n)
    centres = some.normal(0, 300, (5, width))
    rows = []
    for k in range(n):
        if kind == "gauss":
            value = some.normal(0, 200, width)
        elif kind == "clusters":
            value = centres[k % 5] + some.normal(0, 20, width)
        elif kind == "same":
            value = centres[0]
        else:  # short and few values: many ties
            value = some.integers(-1, 3, 1 + k % width)
        rows.append((k, int(some.integers(0, 3)), [int(x) for x in value], 1, "x"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("kind", ["gauss", "clusters", "same", "ties"])
def test_several_chunks(spark, kind, monkeypatch):
    rows = rows_of(kind, 300)
    rows += rows[7:10] + [(400, None, [1], 1, ""), (401, 1, None, 1, ""), (None, 1, [1], 1, "")]
    df = frame(spark, rows)
    anchors = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    wanted = plain(rows, anchors)
    assert wanted or kind in ("ties", "same")  # of one score, no negative lies below 95 %
    got = hard_negatives(df, df.filter("vec_id % 10 = 0"), chunk=40, batch=7)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == wanted
    if kind == "clusters":
        monkeypatch.setattr(covertree, "MOST_ROOTS", 1)
        assert sorted(map(tuple, hard_negatives(df, df.filter("vec_id % 10 = 0"), chunk=40, batch=7).collect())) == wanted


def test_large_components_are_exact(spark):
    rows = [(k, k % 2, [(1 << 29) + k * 7, (1 << 28) + k % 5, k], 1, "") for k in range(60)]
    df = frame(spark, rows)
    assert sorted(map(tuple, hard_negatives(df, df.filter("vec_id % 10 = 0"), chunk=25).collect())) == plain(rows, [r for r in rows if r[0] % 10 == 0])


def test_few_rows(spark):
    assert hard_negatives(frame(spark, []), frame(spark, [])).count() == 0
    one = frame(spark, [(0, 1, [5, 5], 1, "")])
    assert hard_negatives(one, one).count() == 0
    empty_vectors = [(0, 1, [], 1, ""), (1, 1, [], 1, ""), (2, 2, [], 1, "")]
    df = frame(spark, empty_vectors)
    assert sorted(map(tuple, hard_negatives(df, df).collect())) == plain(empty_vectors, empty_vectors)


@pytest.mark.parametrize("kind", ["gauss", "clusters", "same", "ties"])
def test_tree_covers_and_bounds(kind):
    rows = rows_of(kind, 900)
    values = covertree._matrix([r[2] for r in rows], 6)
    tree = CoverTree(np.arange(900), np.zeros(900, np.int64), values.astype(float), leaf=4)
    norms = (values.astype(float) ** 2).sum(1)
    points = np.column_stack([values, np.sqrt(np.maximum(tree.most - norms, 0))])
    query = values[3].astype(float)[None, :]

    def held(node):
        below = [p for c in node.children for p in held(c)]
        every = [*node.own.tolist(), *below]
        distance = np.linalg.norm(points[every] - points[node.centre], axis=1)
        assert distance.max() <= node.radius * (1 + 1e-9) + 1e-6
        lower, upper = tree.bounds(query @ values[[node.centre]].T.astype(float), (query * query).sum(1), np.array([node.radius]))
        products = values[every] @ query[0]
        assert lower[0, 0] <= products.min() and products.max() <= upper[0, 0]
        for child in node.children:
            assert child.radius <= node.radius * (1 + 1e-9) + 1e-6
        return every

    assert sorted(held(tree.root)) == list(range(900))


def test_descent_skips_nodes():
    rows = rows_of("clusters", 4000, 12)
    values = covertree._matrix([r[2] for r in rows], 12).astype(float)
    tree = CoverTree(np.arange(4000), np.array([r[1] for r in rows]), values)
    scored = []
    held = covertree.Held.take
    low, high = np.full((1, 1), -np.inf), np.full((1, 1), np.inf)
    try:
        covertree.Held.take = lambda self, rows, got, ids, fits: (scored.append(got.size), held(self, rows, got, ids, fits))[1]
        scores, ids = tree.search(Anchors(np.array([5]), np.array([rows[5][1]]), values[[5]], low, high), 5, True)
    finally:
        covertree.Held.take = held
    products = values @ values[5]
    order = sorted((k for k in range(4000) if rows[k][1] == rows[5][1] and k != 5), key=lambda k: (-products[k], k))[:5]
    assert ids[0, 0].tolist() == order and scores[0, 0].tolist() == products[order].tolist()
    assert sum(scored) < 1500


def test_windows():
    assert covertree.window(100) == (50, 95) and covertree.window(101) == (51, 95) and covertree.window(0) == (0, 0)
    low, high = covertree.window(-100)
    assert low > high
