"""The pipeline's stages against brute force, each on its own input, and the queries on the smallest tables."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import helpers as H  # noqa: E402

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from loomstat.llm import nearcopies, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SPEECH = {
    "en": "the of and that with from this have which their would there about other when your said each time".split(),
    "de": "der die und nicht mit aus diese haben welche ihre würde dort über andere wenn deine sagte jede zeit".split(),
}


def shingles(text, width=5):
    words = H.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def groups_of(texts, similarity=0.8):
    own = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(own[i] & own[j]) >= similarity * len(own[i] | own[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(k) for k in range(len(texts))]


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose in two languages with exact and near copies and personal data."""
    random.seed(9)
    made = []
    for k in range(60):
        lang = "en" if k % 3 else "de"
        words = [random.choice(SPEECH[lang]) + random.choice(["", "s", "er", "e"]) for _ in range(random.randint(80, 150))]
        made.append((" ".join(words), lang))
    for k in range(0, 60, 4):  # near copies: one word changed, of which five shingles of over 76 change
        words = made[k][0].split()
        words[len(words) // 2] = "changed"
        made += [(" ".join(words), made[k][1]), made[k]]
    made[7] = (made[7][0] + " write to bob@mail.example.com or call +1 (017) 555-7713", "en")
    rows = [(k, t, lang, f"s{k % 4}" if k % 5 else None, len(t)) for k, (t, lang) in enumerate(made)]
    rows += [(900, None, "en", "s1", 0), (901, "", None, "s1", 0), (902, "12345", "en", "s1", 5)]
    return spark.createDataFrame(rows, H.SCHEMA)


def test_stages_decide_as_brute_force_does(spark, corpus, tmp_path):
    docs, seen = corpus, {}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs.collect(), docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs.collect())
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    before, after = seen["language_id"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {900, 901, 902}
    before, after = seen["near_duplicates"]
    first = {}
    for r, group in zip(before, groups_of([r["text"] for r in before])):
        first[group] = min(first.get(group, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(first.values())
    before, after = seen["pii"]
    assert len(before) == len(after) and not any(H.base_spans(r["text"]) for r in after)
    text = {r["doc_id"]: r["text"] for r in after}
    assert text[7].endswith("write to [EMAIL] or call [PHONE]")
    assert all(text[r["doc_id"]] == r["text"] for r in before if not H.base_spans(r["text"]))
    before, after = seen["mixing"]
    size = lambda rows, s: sum(len(H.WORD.findall(r["text"])) for r in rows if r["source"] == s)
    times = Counter(r["doc_id"] for r in after)
    assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in before}
    assert abs(sum(size(after, s) for s in {r["source"] for r in before}) - 1.5 * sum(size(before, s) for s in {r["source"] for r in before})) < 5 * 200
    before, after = seen["packing"]
    assert sum(r["length"] for r in after) == sum(r["doc_tokens"] for r in after if r["start"] == 0)
    assert Counter(r["doc_id"] for r in after if r["start"] == 0) == Counter(r["doc_id"] for r in before)


def test_run_is_its_stages(spark, tmp_path):
    found = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    digest = lambda df: sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in df.collect())
    assert digest(found) == digest(docs)


def test_near_copies_on_awkward_documents(spark):
    docs = H.documents(spark)
    kept = nearcopies.deduplicated(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    groups = groups_of([r["text"] for r in rows])
    group = {(r["doc_id"], r["text"]): g for r, g in zip(rows, groups)}
    assert Counter(group[r["doc_id"], r["text"]] for r in kept.collect()) == Counter(set(groups))
    assert nearcopies.deduplicated(H.empty(spark)).count() == 0


def test_large_group_of_copies(spark):
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one and the same text again and again").alias("text"))
    other = same.withColumn("text", F.concat("text", F.lit(" "), F.md5(F.col("doc_id").cast("string")), F.lit(" "), F.md5((F.col("doc_id") + 1).cast("string")))).limit(50)
    kept = nearcopies.deduplicated(same.union(other.withColumn("doc_id", F.col("doc_id") + 5000)))
    assert kept.filter("doc_id < 3000").count() == 1 and kept.filter("doc_id >= 5000").count() == 50


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_crowded_shingles_take_several_rounds(spark, monkeypatch, broadcast):
    for name, value in (("WIDTH", 1), ("WIDER", 2), ("PART", 16), ("COUNTED", 2), ("MOST_BROADCAST", broadcast)):
        monkeypatch.setattr(nearcopies, name, value)
    random.seed(5)
    words = [random.choice(SPEECH["en"]) + random.choice("abcdefgh") for _ in range(200)]
    copies = [" ".join([*words[:k], "edit", *words[k + 1 :]]) for k in range(0, 200, 2)]
    docs = spark.createDataFrame(list(enumerate([" ".join(words), *copies])), "doc_id long, text string")
    assert [r["doc_id"] for r in nearcopies.deduplicated(docs).collect()] == [0]


def test_crowded_shingles_lose_no_link(spark, monkeypatch):
    for name, value in (("WIDTH", 1), ("WIDER", 2), ("PART", 8)):
        monkeypatch.setattr(nearcopies, name, value)
    random.seed(8)
    passage, texts = _prose(100), []
    for k in range(80):  # about 0.75 to each other, and chains of copies among them
        words = [*passage, *_prose(14)]
        texts.append(" ".join(words))
        for _ in range(k % 4):
            at = random.randrange(len(words))
            words[at] = f"edit{at}"
            texts.append(" ".join(words))
    random.shuffle(texts)
    assert 10 < _one_of_each_group(spark, texts) <= 80


def test_parities_never_rule_out_similar_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 300, 2000):
        for share in (0.0, 0.1, 0.5, 1.0):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[int(share * n) :], rng.integers(0, 1 << 63, rng.integers(0, n + 1)).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            least = nearcopies.difference(nearcopies.parities(a), nearcopies.parities(b))
            assert least <= len(np.setxor1d(a, b)) and nearcopies.difference(nearcopies.parities(a), nearcopies.parities(a)) == 0


@pytest.mark.parametrize("name", sorted(queries.MODULES))
def test_queries_run_whole(spark, name):
    found = __spark_entry__.queries()[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name == "op3_topk_search":
        assert found.count() == 50
    elif name == "op13_hard_negatives":
        assert found.count() == 150  # 10 anchors, 5 positives, 3 negatives
    elif name == "op1_packing":
        assert found.select("doc_id").distinct().count() == n
    else:
        assert found.count() == n


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = __spark_entry__.queries()[name](spark, SF).toPandas()
    wanted = con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert sorted(wanted.columns) == columns
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    assert order(found).equals(order(wanted))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    told = __spark_entry__.queries()["op7_language_id"](spark, sf).filter("held_out").join(docs, "doc_id")
    assert told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = __spark_entry__.queries()["op6_quality_classifier"](spark, sf).filter("held_out").join(labels, "doc_id")
    assert scored.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.97
    judged = __spark_entry__.queries()["op5_quality_rules"](spark, sf).join(labels, "doc_id").filter("not base_failed")
    assert judged.agg(F.avg((F.col("quality") == F.col("kept").cast("int")).cast("int"))).first()[0] > 0.97


def _prose(n, vocabulary=5000):
    return [f"w{random.randrange(vocabulary)}" for _ in range(n)]


def _one_of_each_group(spark, texts):
    found = nearcopies.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    groups = groups_of(texts)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(set(groups))
    return len(set(groups))


@pytest.mark.parametrize("n", [50, 200, 500])
def test_small_groups_that_share_a_long_passage(spark, n):
    random.seed(n)
    passage, texts = _prose(168), []
    for _ in range(n):
        words = [*passage, *_prose(32)]
        texts += [" ".join(words), " ".join([*words[:-4], *_prose(4)])]  # 0.73 to the others, 0.96 to its copy
    assert _one_of_each_group(spark, texts) == n


@pytest.mark.parametrize("kind", ["appended", "replaced", "scattered"])
def test_every_kind_of_edit_is_found(spark, kind):
    random.seed(4)
    texts = []
    for k in range(150):
        words = _prose(random.randint(170, 400))
        n = len(words)
        texts.append(" ".join(words))
        if kind == "appended":  # n of n + m shingles stay
            words += _prose(int(n * random.uniform(0.12, 0.24)))
        elif kind == "replaced":
            m = int(n * random.uniform(0.05, 0.105))
            at = random.randrange(n - m)
            words[at : at + m] = _prose(m)
        else:
            for at in random.sample(range(n), int(n * random.uniform(0.012, 0.022))):
                words[at] = "edit"
        texts.append(" ".join(words))
    assert 150 <= _one_of_each_group(spark, texts) < 200  # a few just under 0.8 are no copies


def test_long_texts_are_told_by_all_their_shingles(spark):
    random.seed(6)
    texts = []
    for k in range(120):  # 0.79 or 0.81 of 400 shingles and more
        words, share = _prose(random.randint(400, 600)), 0.79 if k % 2 else 0.81
        texts += [" ".join(words), " ".join([*words, *_prose(round((len(words) - 4) * (1 / share - 1)))])]
    assert _one_of_each_group(spark, texts) == 180


def test_last_stage_gives_the_token_ids(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    some = corpus.filter("doc_id < 5")
    found = corpus_pipeline.STAGES[-1][1](spark, some, SF).orderBy("doc_id", "start").collect()
    for r in some.collect():
        ids = [i for f in found if f["doc_id"] == r["doc_id"] for i in f["ids"]]
        assert ids == [*library.encode(r["text"], add_special_tokens=False).ids, 1]
