"""Operators on awkward documents, against brute force."""

import hashlib
import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from itertools import groupby
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import helpers as H  # noqa: E402
from loomstat.llm import discriminant, language, mixing, packing, pii, rules, sharding, simhash, tokens  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return H.documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_packing_round_trip(docs, rows):
    library = Tokenizer.from_file(WORDS)
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows}
    found = packing.pack(docs, WORDS, seq_len=64, with_ids=True).collect()
    assert len({r["sequence_id"] for r in found}) == len(found) and all(r["offset"] == 0 for r in found)
    assert all(r["length"] == 1 << r["bucket"] <= 64 == max(64, r["length"]) for r in found)
    by_doc = defaultdict(list)
    for r in found:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"]].append(r)
    whole = Counter((d, tuple(ids[t])) for d, t in rows)
    for (doc, wanted), times in whole.items():
        own = sorted((r for r in by_doc[doc] if r["doc_tokens"] == len(wanted)), key=lambda r: r["start"])
        at = 0
        for start, group in groupby(own, key=lambda r: r["start"]):
            matching = [r for r in group if tuple(r["ids"]) == wanted[start : start + r["length"]]]
            assert start == at and len(matching) >= times
            at += matching[0]["length"]
        assert at == len(wanted)


def test_piece_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000):
        sizes = packing.piece_lengths(n, 2048)
        assert sum(sizes) == n and all(s & (s - 1) == 0 and s <= 2048 for s in sizes)
        assert len(sizes) == n // 2048 + bin(n % 2048).count("1")
    with pytest.raises(ValueError):
        packing.pack(None, WORDS, seq_len=100)


def test_token_counts_match_the_library(docs, rows):
    library = Tokenizer.from_file(BYTES)
    wanted = Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    found = tokens.count_tokens(docs, BYTES).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in found) == wanted
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)


def test_pii_matches_brute_force(docs, rows):
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    wanted = Counter((d, said(H.base_spans(t))) for d, t in rows)
    found = pii.found(docs).collect()
    assert Counter((r["doc_id"], said((s["kind"], s["start"], s["end"]) for s in r["base_spans"])) for r in found) == wanted
    kinds = Counter(s["kind"] for r in found for s in r["further_spans"])
    assert kinds == {"iban": 2, "ssn": 2, "secret": 1}


def test_redaction(spark, docs):
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert not any(H.base_spans(t) for t in text.values())
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(text[d] == t for d, t in before.items() if not H.base_spans(t) and not any(w in (t or "") for w in ("iban", "ssn", "token =")))
    assert any("mail [EMAIL] or [EMAIL][EMAIL]" in (t or "") for t in text.values()) or any("[EMAIL]" in (t or "") for t in text.values())
    assert clean.filter("n_chars <> length(text)").isEmpty()


def test_checksums(spark):
    df = spark.createDataFrame([("79927398713", "DE89370400440532013000"), ("79927398710", "DE89370400440532013001")], "card string, iban string")
    assert [tuple(r) for r in df.select(pii.luhn(F.col("card")), pii.mod97(F.col("iban"))).collect()] == [(True, True), (False, False)]


def test_statistics_match_brute_force(docs, rows):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = rules.statistics(docs).collect()
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in found) == Counter((d, *H.counts(t)) for d, t in rows)


def test_rules_learn_and_judge(spark):
    texts = [" ".join(f"w{(k * 7 + j) % 97}" for j in range(60)) for k in range(90)]
    junk = [" ".join(f"w{(k + j) % 89}###" for j in range(60)) for k in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + junk)] + [(500, None), (501, "too short")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 90)) for k in range(130)] + [(7, None), (9999, 0)], "doc_id long, quality int")
    kept = {r["doc_id"]: r for r in rules.judged(docs, labels).collect()}
    assert all(kept[k]["kept"] for k in range(90)) and not any(kept[k]["kept"] for k in range(90, 130))
    assert kept[500]["base_failed"] and kept[501]["base_failed"] and kept[500]["n_words"] == 0
    assert rules.judged(docs, labels.limit(0)).filter("kept <> (not base_failed)").isEmpty()
    assert rules.judged(docs.limit(0), labels).count() == 0


def test_discriminant_separates(spark, docs):
    good = [" ".join(f"word{(k * 13 + j * j) % 211}" for j in range(40 + k)) + "." for k in range(60)]
    bad = [t.upper().replace(" ", "!! ") for t in good[:30]]
    train = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    measures = discriminant.measured(train).withColumn("quality", (F.col("doc_id") < 60).cast("int"))
    model = discriminant.fitted(measures)
    scores = {r["doc_id"]: r["score"] for r in discriminant.scored(measures, model).collect()}
    assert all((s >= 0.5) == (d < 60) for d, s in scores.items())
    everything = discriminant.scored(discriminant.measured(docs), model).collect()
    assert len(everything) == docs.count() and all(0.0 <= r["score"] <= 1.0 for r in everything)
    assert discriminant.fitted(measures.limit(0)).scores(np.zeros((2, len(discriminant.FEATURES)))).tolist() == [0.5, 0.5]
    assert 0 < discriminant.fitted(measures.filter("quality = 1")).scores(np.zeros((1, len(discriminant.FEATURES))))[0] < 1


def test_language_rejects_and_tells(spark, docs):
    speech = {"en": "the quick brown fox jumps over the lazy dog and then it runs away from here ", "de": "der schnelle braune fuchs springt und läuft dann schnell nach hause zurück "}
    cut = lambda s, k: " ".join(np.roll(s.split(), k))
    train = spark.createDataFrame([(k, cut(s, k), lang) for lang, s in speech.items() for k in range(14)], "doc_id long, text string, lang string")
    learned = language.dictionaries(train.union(spark.createDataFrame([(99, "no label", None), (98, None, "en"), (97, "123", "en")], train.schema)))
    assert set(learned) == {"en", "de"}
    found = {r["doc_id"]: r for r in language.classified(train, learned).collect()}
    assert all(found[r["doc_id"]]["lang_pred"] in ("en", "de") for r in train.collect())
    told = language.classified(spark.createDataFrame([(1, speech["en"]), (2, speech["de"].upper())], "doc_id long, text string"), learned).collect()
    assert [(r["lang_pred"], r["rejected"]) for r in told] == [("en", False), ("de", False)]
    every = language.classified(docs, learned).collect()
    letters = {(r["doc_id"], r["text"]) for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert sum(r["lang_pred"] == "und" for r in every) == sum((r["doc_id"], r["text"]) not in letters for r in docs.collect())
    assert all(r["rejected"] and r["score"] == 0 for r in every if r["lang_pred"] == "und")
    assert language.accepted(docs, learned).columns == docs.columns
    assert {r["lang_pred"] for r in language.classified(docs, {}).collect()} == {"und"}
    assert language.dictionaries(train.limit(0)) == {}


def plain_targets(sizes, weights, budget, most):
    """Shares of the budget by weight; those above their limit stop there and leave the rest to the others, until none is above."""
    found, full = {}, set()
    while True:
        left = budget - sum(most * sizes[k] for k in full)
        rest = [k for k in range(len(sizes)) if k not in full]
        found = {k: most * sizes[k] for k in full} | {k: left * weights[k] / sum(weights[j] for j in rest) for k in rest}
        above = {k for k in rest if found[k] > most * sizes[k]}
        if not above:
            return [float(found[k]) for k in range(len(sizes))]
        full |= above


def test_mixing_targets(spark):
    def targets(sizes, weights=(5, 2, 1)):
        sources = [(False, f"s{k:03}", size) for k, size in enumerate(sizes[:-1])] + [(True, None, size) for size in sizes[-1:]]
        made = spark.createDataFrame(sources, "unnamed boolean, source string, source_size long")
        told = {r["source"]: r["target"] for r in mixing.targets(made, weights).collect()}
        return [told[source] for _, source, _ in sources]

    assert targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3]
    assert targets([10, 1000]) == [20.0, 1495.0]
    assert targets([]) == [] and targets([0, 0]) == [0.0, 0.0]
    for sizes in ([7, 40, 3, 900, 25, 60], [0, 5], [4**k for k in range(12)], [(k * 7919) % 1000 for k in range(100)]):
        found = targets(sizes)
        assert found == pytest.approx(plain_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], 1.5 * sum(sizes), 2))
        assert sum(found) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(found, sizes))


def test_mixing_takes_near_targets(spark, docs):
    made = spark.createDataFrame([(k, "w " * (1 + (k * 37) % 120), ["a", "b", "c", None][0 if k % 3 == 0 else k % 4]) for k in range(600)], "doc_id long, text string, source string")
    found = mixing.copies(made).join(made.select("doc_id", "source"), "doc_id").toPandas()
    for _, g in found.groupby("source", dropna=False):
        assert abs((g["size"] * g["copies"]).sum() - g["target"].iloc[0]) <= g["size"].max() and g["copies"].max() <= 2
    again = mixing.copies(made.repartition(7)).toPandas()
    key = lambda d: sorted(zip(d["doc_id"], d["copies"]))
    assert key(found) == key(again)
    every = mixing.copies(docs)
    assert every.count() == docs.count()
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == every.agg(F.sum("copies")).first()[0]


def test_shards_are_even_and_gapless(spark, docs):
    sizes = [(k, "é" * ((k * 7919) % 300), "hot" if k % 3 else f"s{k % 9}", "en") for k in range(2000)]
    for df, n in ((spark.createDataFrame(sizes, "doc_id long, text string, source string, lang string"), 40), (spark.createDataFrame([(1, "same", None, None)] * 400, "doc_id long, text string, source string, lang string"), 7)):
        found = sharding.sharded(df, n).toPandas()
        own = found.groupby("shard")
        total, most = found["size"].sum(), found["size"].max()
        assert len(found) == df.count() and set(found["shard"]) == set(range(n))
        assert (own["size"].sum() - total / n).abs().max() <= 2 * most
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in own)
    odd = sharding.sharded(docs, None, target_bytes=100_000).toPandas()
    assert len(odd) == docs.count() and odd["shard"].nunique() > 2
    assert {(r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in docs.collect()} == {(None if pd.isna(a) else int(a), b) for a, b in zip(odd["doc_id"], odd["text_crc32"])}


def test_large_trees_have_the_cuts_of_small_ones(spark, monkeypatch):
    rows = [(k, "x" * (k * 7919 % 300), "hot" if k % 3 else f"s{k % 9}", "en") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    placed = lambda: sorted(map(tuple, sharding.sharded(df, 30).select("doc_id", "shard", "slot").collect()))
    one = placed()
    monkeypatch.setattr(sharding, "MOST_SHARDS", 4)
    monkeypatch.setattr(sharding, "DEPTH", 2)
    monkeypatch.setattr(sharding, "MOST_BINS", 64)
    assert placed() == one


STRICT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.sql.codegen.factoryMode", "CODEGEN_ONLY").config("spark.sql.codegen.fallback", "false").getOrCreate())
import __spark_entry__
for name in ("op2_sharding", "op9_mixing", "op12_merkle"):
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_generated_code_compiles():
    root = str(Path(__file__).resolve().parents[2])
    said = subprocess.run([sys.executable, "-c", STRICT], capture_output=True, text=True, timeout=600, cwd=root, env=os.environ)
    assert "op12_merkle 200" in said.stdout, said.stderr[-2000:]
    assert "Failed to compile" not in said.stderr


def brute_fingerprint(text, shingle):
    from xxhash import xxh64_intdigest

    words = H.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force(docs, rows):
    found = simhash.fingerprints(docs, 3).collect()
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in found)
    assert got == Counter((d, brute_fingerprint(t, 3)) for d, t in rows)


@pytest.mark.parametrize("radius", [0, 2])
def test_classes_match_brute_force(spark, radius):
    rng = np.random.default_rng(5)
    prints = rng.integers(-(1 << 63), (1 << 63) - 1, 60).tolist()
    for k in range(240):  # chains and balls around earlier ones, and copies
        old = prints[int(rng.integers(len(prints)))] & (1 << 64) - 1
        for b in rng.integers(0, 64, int(rng.integers(0, 3))).tolist():
            old ^= 1 << b
        prints.append(old - (1 << 64) if old >> 63 else old)
    df = spark.createDataFrame([(k, p) for k, p in enumerate(prints)] + [(None, prints[3])], "doc_id long, fp long")
    found = {r["doc_id"]: r["component_id"] for r in simhash.classes(df, radius).collect() if r["doc_id"] is not None}
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin((prints[i] ^ prints[j]) & (1 << 64) - 1).count("1") <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert found == {k: top(k) for k in range(len(prints))}


def test_deduplication_keeps_one_of_each(docs, rows):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len({(r["doc_id"], r["text"]) for r in got}) == len(got)
    assert len({brute_fingerprint(r["text"], 3) for r in got}) == len({brute_fingerprint(t, 3) for _, t in rows})
    assert 900 in {r["doc_id"] for r in got} and 901 not in {r["doc_id"] for r in got}


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1, 1)], "doc_id long, fp long"), 3)


def test_empty_tables(spark):
    none = H.empty(spark)
    assert packing.pack(none, WORDS).count() == 0
    assert tokens.count_tokens(none, BYTES).count() == 0
    assert pii.found(none).count() == 0 and pii.redacted(none).count() == 0
    assert rules.statistics(none).count() == 0
    assert mixing.copies(none).count() == 0 and mixing.mixed(none).count() == 0
    assert sharding.sharded(none, 40).count() == 0 and sharding.sharded(none, None, target_bytes=10).count() == 0
    assert simhash.deduplicated(none).count() == 0
    assert language.accepted(none, {}).count() == 0
    assert discriminant.scored(discriminant.measured(none), discriminant.Discriminant(0.5)).count() == 0


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_account_numbers_end_where_their_country_says(spark):
    texts = {
        "IBAN DE89370400440532013000 BIC COBADEFFXXX": "IBAN [IBAN] BIC COBADEFFXXX",
        "DE89 3704 0044 0532 0130 00 TODAY": "[IBAN] TODAY",
        "GB82 WEST 1234 5698 7654 32 A new": "[IBAN] A new",
        "NO9386011117947 NO93 8601 1117 947 OR": "[IBAN] [IBAN] OR",
        "REF AB12 DE89370400440532013000": "REF AB12 [IBAN]",
        "DE89370400440532013001 BIC": "DE89370400440532013001 BIC",
    }
    found = pii.redacted(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id")
    assert [r["text"] for r in found.collect()] == list(texts.values())


def test_mixing_keeps_rows_of_one_document_in_their_sources(spark):
    rows = [(k, f"text {k} of some words", source, lang) for k in range(40) for source, lang in (("a", "en"), ("b", "en"), ("b", None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    wanted = mixing.copies(docs, carried=("source",)).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    mix = mixing.mixed(docs)
    assert {r["source"]: r["count"] for r in mix.groupBy("source").count().collect()} == {r["source"]: r["n"] for r in wanted}
    assert set(map(tuple, mix.distinct().collect())) <= set(rows) and mix.filter("source = 'b' and lang is null").count() > 0


def test_dictionaries_are_drawn_from_the_letters_of_whole_texts(spark):
    rows = [(k, "1" * 500 + " " + lang_word * 30, lang) for k in range(20) for lang, lang_word in (("en", "the house and "), ("de", "das haus und "))]
    rows += [(100 + k, "opening " * 50 + "closing " * 200, "fr") for k in range(20)]
    learned = language.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) == {"en", "de", "fr"} and b"closing" in learned["fr"]


def test_many_languages_and_dirty_labels_stay_bounded(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = {f"l{k:03}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(200)}
    rows = [(k * 100 + i, " ".join(rng.choice(own, 40)), lang) for k, (lang, own) in enumerate(words.items()) for i in range(5)]
    rows += [(10**6 + k, "some words", f"dirty {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.dictionaries(df)
    assert set(learned) == set(words)
    found = language.classified(df.filter("doc_id < 1000"), learned).join(df.select("doc_id", "lang"), "doc_id")
    assert found.filter("lang_pred = lang").count() == found.count() == 50
    assert len(language.dictionaries(df, most=7)) == 7


def test_checkpoints_go_with_their_last_reference(spark):
    import gc
    import time

    from loomstat.llm.common import checkpointed, released

    made = checkpointed(spark.range(100))
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {p.name for p in folder.glob("rdd-*")}
    again = checkpointed(made.withColumn("x", F.col("id") * 2))
    new = {p.name for p in folder.glob("rdd-*")} - before
    assert len(new) == 1 and again.count() == 100
    del again
    for _ in range(30):
        gc.collect()
        released(spark)
        time.sleep(0.2)
        if not new & {p.name for p in folder.glob("rdd-*")}:
            break
    assert not new & {p.name for p in folder.glob("rdd-*")}
    assert made.count() == 100
