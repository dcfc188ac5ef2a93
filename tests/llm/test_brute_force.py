"""Operators that SQL cannot express, against plain versions of what they compute."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import helpers as H  # noqa: E402

import __spark_entry__  # noqa: E402
from loomstat.llm import discriminant, language, mixing, nearcopies, packing, pii, rules, sharding, simhash  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_words_with_marks_get_the_library_ids():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    random.seed(2)
    signs = ["I", "i", "A", "E", "z", "9", "=", " ", "'", "-", "\u0307", "\u0338", "\u0301", "\u0323", "\u20d0", "\u0130", "\u00c9", "\u4e2d", "\n"]
    texts = ["I\u0307\u0338", "xI\u0307\u0338y A\u0301B", *("".join(random.choices(signs, k=random.randint(1, 9))) for _ in range(4000))]
    wanted = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, a, b in zip(texts, own.encode([t.encode() for t in texts]), wanted) if a != b]
    assert not wrong, [ascii(t) for t in wrong[:10]]


def plain_tree(rows, first, shards, spans):
    """Shards by exact weighted medians: rows are (size, (keys)); returns shard by row number."""
    if shards == 1 or not rows:
        return {k: first for k, *_ in rows}
    widths = [max(r[2][d] for r in rows) // (1 << sharding.LOW) - min(r[2][d] for r in rows) // (1 << sharding.LOW) for d in range(3)]
    spans = spans or [max(w, 1) for w in widths]
    d = max(range(3), key=lambda d: widths[d] / spans[d])
    n_left, total = shards // 2, sum(r[1] for r in rows)
    aim, below = total * n_left / shards, 0
    for key, group in sorted({r[2][d]: sum(x[1] for x in rows if x[2][d] == r[2][d]) for r in rows}.items()):
        if below + group >= aim:
            break
        below += group
    threshold = key + (aim - below > below + group - aim)
    left, right = [r for r in rows if r[2][d] < threshold], [r for r in rows if r[2][d] >= threshold]
    return plain_tree(left, first, n_left, spans) | plain_tree(right, first + n_left, shards - n_left, spans)


@pytest.mark.parametrize("shards", [2, 7, 16])
def test_tree_is_that_of_exact_medians(spark, shards):
    random.seed(shards)
    rows = [(k, random.randint(1, 500), tuple(random.randrange(40) << sharding.LOW | random.getrandbits(31) for _ in range(3))) for k in range(400)]
    points = spark.createDataFrame([(k, s, *keys) for k, s, keys in rows], "id long, size long, key0 long, key1 long, key2 long").cache()
    found = {r["id"]: r["shard"] for r in sharding.kd_tree(points, shards, 3).select("id", "shard").collect()}
    assert found == plain_tree(rows, 0, shards, None)


def test_shards_do_not_depend_on_the_layout(spark):
    docs = H.documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    of = lambda df: Counter((r["doc_id"], r["shard"]) for r in sharding.sharded(df, 6).collect())
    assert of(docs) == of(docs.repartition(5))


def test_trees_of_trees_are_one_tree(spark, monkeypatch):
    """19 shards of trees of at most 4 or 2 leaves; some parts are empty where there are fewer rows than shards."""
    docs = H.documents(spark)
    of = lambda df: Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.sharded(df, 19).collect())
    for df in (docs, docs.filter("doc_id is not null").limit(3), docs.limit(0)):
        df = spark.createDataFrame(df.collect(), df.schema)
        once = of(df)
        for most in (4, 2):
            monkeypatch.setattr(sharding, "MOST_SHARDS", most)
            assert of(df) == once
        monkeypatch.undo()


def test_discriminant_is_the_plain_one(spark):
    rng = np.random.default_rng(1)
    width = len(discriminant.FEATURES)
    x = rng.normal(size=(300, width)) * np.linspace(1, 3, width)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=300) > 1).astype(int)
    rows = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, y))], "doc_id long, x array<double>, quality int").repartition(3)
    scores = {r["doc_id"]: r["score"] for r in discriminant.scored(rows, discriminant.fitted(rows)).collect()}
    z = np.clip((x - x.mean(0)) / x.std(0), -discriminant.REACH, discriminant.REACH)
    covariance = [np.cov(z[y == c].T, ddof=0) for c in (0, 1)]
    pooled = np.diag(sum((y == c).sum() * np.diag(covariance[c]) for c in (0, 1)) / len(y))
    density = []
    for c in (0, 1):
        s = (1 - discriminant.SHRINKAGE) * covariance[c] + discriminant.SHRINKAGE * pooled + discriminant.FLOOR * np.eye(width)
        away = z - z[y == c].mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(s), away) - 0.5 * np.linalg.slogdet(s)[1])
    prior = (y.sum() + 0.5) / (len(y) + 1)
    wanted = 1 / (1 + np.exp(-(density[1] - density[0] + np.log(prior / (1 - prior))) / discriminant.TEMPERATURE))
    assert np.allclose([scores[k] for k in range(len(y))], wanted, atol=1e-8)


def test_languages_are_told_by_the_smallest_size(spark):
    import zstandard

    random.seed(3)
    speech = {"en": "the house and a garden with some trees", "de": "das haus und ein garten mit vielen bäumen", "fr": "la maison et un jardin avec des arbres"}
    learned = {lang: (" ".join(random.choices(s.split(), k=400))).encode() for lang, s in speech.items()}
    texts = [" ".join(random.choices(speech[random.choice(list(speech))].split() + ["42!", "X-y"], k=random.randint(1, 2000))) for _ in range(60)]
    found = {r["doc_id"]: r for r in language.classified(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), learned).collect()}

    def size(text, content):  # from a dictionary that is made for each text
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = lambda p: zstandard.ZstdCompressor(level=language.LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False).compress(p)
        return sum(len(press(text[k : k + language.PIECE])) for k in range(0, len(text), language.PIECE))

    for k, text in enumerate(texts):
        plain, gap = "", False
        for c in text.lower():
            plain, gap = (plain + c, False) if c.isalpha() else (plain if gap else plain + " ", True)
        sizes = {lang: size(plain.encode(), content) for lang, content in learned.items()}
        best = min(sizes.values())
        assert sizes[found[k]["lang_pred"]] == best
        assert found[k]["rejected"] == (sorted(sizes.values())[1] - best <= language.MARGIN * best)


def test_sample_is_bounded_with_null_and_repeated_ids(spark):
    rows = [(None if k % 2 else 7, f"word{k} " * 30, "en") for k in range(3000)] + [(None, "one and the same text", "de")] * 2000
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.drawn(known, {"en": 3000, "de": 2000}, sample=50).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in found}["en"] == 50 and all(r["count"] <= 50 for r in found)
    told = [{r["text"] for r in language.drawn(df, {"en": 3000, "de": 2000}, sample=50).filter("lang = 'en'").collect()} for df in (known, known.repartition(7))]
    assert told[0] == told[1]


def test_mix_of_one_id_in_two_sources(spark):
    rows = [(1, "one text of six words here", s) for s in ("a", "b") for _ in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = {r["source"]: r for r in mixing.copies(docs, carried=("source",)).groupBy("source").agg(F.sum("copies").alias("n"), F.max("copies").alias("most"), F.max("target").alias("target")).collect()}
    mix = {r["source"]: r["count"] for r in mixing.mixed(docs).groupBy("source").count().collect()}
    assert mix == {s: r["n"] for s, r in told.items()} and all(r["most"] <= 2 and abs(6 * r["n"] - r["target"]) <= 6 for r in told.values())


def test_mix_of_null_and_repeated_ids_is_the_same_each_time(spark):
    rows = [(None if k % 2 else 5, "w " * (k % 90 + 1), "a" if k % 3 else None) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    of = lambda df: Counter((r["doc_id"], r["text_hash"], r["copies"]) for r in mixing.copies(df).collect())
    assert of(docs.repartition(2)) == of(docs.repartition(9))


def test_copies_are_kept_the_same_each_time(spark):
    rows = [(k % 5, f"text {k % 5} of a few words", s) for k in range(20) for s in ("a", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for keep in (simhash.deduplicated, nearcopies.deduplicated):
        assert {tuple(r) for r in keep(docs).collect()} == {tuple(r) for r in keep(docs.repartition(7)).collect()}


def test_spans_stay_linear_and_right_in_long_texts(spark):
    text = "".join(f"host 10.0.{k % 250}.{k % 200} é " for k in range(3000)) + "end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.found(docs).first()["base_spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == H.base_spans(text)
    assert all(s["score"] == pytest.approx(1.0) for s in spans)  # "host" is near
    assert pii.redacted(docs).first()["text"] == "host [IP] é " * 3000 + "end"


def test_running_folds(spark):
    n = 3 * pii.STRETCH + 5
    df = spark.createDataFrame([(list(range(n)),), ([],), ([4],)], "v array<int>")
    total, far = (pii.running(F.col("v"), f) for f in (lambda a, b: a + b, lambda a, b: F.greatest(a, b)))
    rows = df.select("v", total.alias("total"), far.alias("far")).collect()
    assert [r["total"] for r in rows] == [np.cumsum(r["v"]).tolist() for r in rows] and [r["far"] for r in rows] == [r["v"] for r in rows]


def test_rules_on_rows_they_did_not_learn_from(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    judged = rules.judged(docs, labels.filter(~held)).filter("not base_failed").join(labels.filter(held), "doc_id")
    counts = judged.agg(F.count_if(F.expr("not kept and quality = 0")).alias("hit"), F.count_if(~F.col("kept")).alias("said"), F.count_if(F.col("quality") == 0).alias("bad")).first()
    assert counts["hit"] >= 0.97 * counts["said"] and counts["hit"] >= 0.9 * counts["bad"]


def test_every_query_of_the_subpackage_is_there():
    assert {"op1_packing", "op10_simhash", "pipeline"} <= set(__spark_entry__.queries())
