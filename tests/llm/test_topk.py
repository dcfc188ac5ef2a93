"""Exact search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import topk


def brute(rows, queries, k):
    found = []
    for q, x in sorted(set(map(lambda r: (r[0], tuple(r[1])), queries))):
        scores = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in rows if v != q)
        found += [(q, n, v, max(min(-s, (1 << 63) - 1), -(1 << 63))) for n, (s, v) in enumerate(scores[:k], 1)]
    return found


def frame(spark, rows):
    return spark.createDataFrame([(v, list(map(int, x))) for v, x in rows], "vec_id long, value array<long>")


@pytest.mark.parametrize("high", [3, 300, 1 << 29])
def test_matches_brute_force(spark, high):
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(-high, high, 6).tolist()) for k in range(300)] + [(400, [1, 2]), (401, []), (402, [0] * 6), (5, [9] * 6), (403, [1, 2])]
    queries = [r for r in rows if r[0] % 50 == 0]
    found = topk.top_k(frame(spark, rows), frame(spark, queries + queries[:1]), chunk=64, block=8, group=3)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, queries, 5))


def test_few_candidates_and_none(spark):
    rows = [(0, [1, 2]), (50, [3, 4]), (51, [0, 1])]
    found = topk.top_k(frame(spark, rows), frame(spark, rows[:2]))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, rows[:2], 5)
    assert topk.top_k(frame(spark, []), frame(spark, rows)).count() == 0
    assert topk.top_k(frame(spark, rows), frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, rows[:1]), frame(spark, rows[:1])).count() == 0


def test_bad_vectors_take_no_part(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]), (5, [0.5, -0.001]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised().alias("value"))
    assert {r["vec_id"]: r["value"] for r in df.collect()} == {1: None, 2: None, 3: None, 4: None, 5: [128, -1], 6: []}


def test_pruning_skips_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (40, 16))
    values = np.repeat(centres, 100, axis=0) + rng.integers(-2, 3, (4000, 16))
    blocks = topk.Blocks(np.arange(4000), values.astype(float), 64)
    scored = []
    real = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, axis=-1: scored.append(keys[0].shape[0]) or real(keys, axis=axis))
    blocks.search(np.arange(20) * 100, values[::200].astype(float), 5)
    assert sum(scored) < 20 * len(blocks.starts) / 2


def clustered(spark, n=3000, centres=12, width=16):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(centres, width)) * 40
    values = np.floor(middle[rng.integers(0, centres, n)] + rng.normal(size=(n, width)) * 4).astype(int)
    return values, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(values)], "vec_id long, value array<long>")


def test_alike_vectors_share_chunks_and_queries_skip_the_others(spark, monkeypatch):
    values, vectors = clustered(spark)
    sent = []
    reached = topk._reached
    monkeypatch.setattr(topk, "_reached", lambda *a, **b: sent.append(reached(*a, **b)) or sent[-1])
    found = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), chunk=250, group=16).collect()
    queries, chunks = 60, 12
    assert sum(df.count() for df in sent) < queries * chunks / 2
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found}
    scores = values @ values.T
    for q in range(0, 3000, 50):
        order = sorted((c for c in range(3000) if c != q), key=lambda c: (-scores[q, c], c))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(c, scores[q, c]) for c in order]


def test_all_chunks_are_asked_where_bounds_are_too_many(spark, monkeypatch):
    monkeypatch.setattr(topk, "MOST_BOUNDS", 0)
    values, vectors = clustered(spark, 400)
    found = topk.top_k(vectors, vectors.filter("vec_id < 3"), chunk=90).collect()
    scores = values @ values.T
    for q in range(3):
        order = sorted((c for c in range(400) if c != q), key=lambda c: (-scores[q, c], c))[:5]
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == order


def test_vectors_of_other_lengths_and_columns_in_many_chunks(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(-50, 50, rng.integers(0, 7)).tolist(), "x", 1) for k in range(300)] + [(900, None, "x", 1), (None, [1], "x", 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, value array<long>, chunk string, rank int")
    found = topk.top_k(vectors, vectors.filter("vec_id % 10 = 0 or vec_id is null"), chunk=40).collect()
    wide = np.array([v + [0] * (6 - len(v)) for _, v, *_ in rows[:300]])
    scores = wide @ wide.T
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found}
    assert len(got) == len(found) == 150
    for q in range(0, 300, 10):
        order = sorted((c for c in range(300) if c != q), key=lambda c: (-scores[q, c], c))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(c, scores[q, c]) for c in order]
