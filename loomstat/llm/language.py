"""Language ID by compression.

Each language has a zstandard raw-content dictionary: texts of that language. A text, in lower
case and with all but its letters as single spaces, is encoded with each dictionary, in pieces
of ``PIECE`` bytes, all of them; the language whose dictionary gives the smallest sum is
predicted. Where the runner-up comes close, the prediction is marked as rejected.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; null
languages, and those of fewer than LEAST_TEXTS texts, teach nothing; with no languages learned every text is ``und``; with one, every text
that has letters is that one; equal sizes go to the language with more texts learned from; repeated
rows are classified each; null or repeated ids neither add to nor take from what is learned; an
empty table gives no rows; other columns, whatever their names, are not carried by ``classified``
and are kept by ``accepted``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_crc, kept, shuffle_partitions, strides, table

UNKNOWN = "und"
#: Bytes of a language's dictionary.
DICTIONARY = 96 << 10
#: Texts at most that a language's dictionary is drawn from, and characters of the passage drawn from each.
SAMPLE, SNIPPET = 400, 400
#: Texts that a value of lang must have to be learned as a language, and languages at most.
LEAST_TEXTS, MOST_LANGUAGES = 5, 256
#: Bytes of text compressed by itself.
PIECE = 4 << 10
LEVEL = 6
#: Bytes by which the best must lead the runner-up, as a share of the best, not to be rejected (equal sizes always are).
MARGIN = 0.02
#: Nats of evidence that a byte saved stands for in the score.
WEIGHT = 0.25


def letters(text: str | Column = "text") -> Column:
    """The text as it is compressed; null for a null text or one without a letter."""
    col = F.col(text) if isinstance(text, str) else text
    return F.when(F.rlike(col, F.lit(r"\p{L}")), F.regexp_replace(F.lower(col), r"[^\p{L}\p{M}]+", " "))


class Compressors:
    """A compressor for each language, and the classification by their sizes."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.names = list(dictionaries)
        self.encoders = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_checksum=False, write_content_size=False).compress)

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[at : at + PIECE] for at in range(0, len(text), PIECE)]
        return [sum(len(encode(p)) for p in pieces) for encode in self.encoders]

    def classify(self, text: bytes) -> tuple[str, float, bool]:
        """The language, its score and whether it is rejected."""
        if not self.names:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(sizes)
        score = 1.0 / sum(math.exp(-WEIGHT * min(s - best, 2000)) for s in sizes)
        runner_up = min((s for k, s in enumerate(sizes) if k != sizes.index(best)), default=None)
        narrow = runner_up is not None and runner_up - best <= MARGIN * best
        return self.names[sizes.index(best)], score, narrow


def _joined(texts: list[str], size: int) -> bytes:
    """The last of the texts, whole ones, that come to ``size`` bytes at most; of a single longer one, its last letters."""
    found: list[bytes] = []
    left = size
    for text in map(str.encode, reversed(texts)):
        if len(text) > left:
            break
        found.append(text)
        left -= len(text) + 1
    return b" ".join(reversed(found)) if found or not texts else texts[-1].encode()[-size:].decode(errors="ignore").encode()


def _agreeing(spark: SparkSession, texts: dict[str, list[str]], size: int) -> dict[str, list[str]]:
    """The texts whose language the other half's texts confirm: labels are wrong now and then. The texts are judged in tasks."""
    halves = [{lang: _joined(own[k::2], size) for lang, own in texts.items() if own[k::2]} for k in (0, 1)]
    names = list(texts)

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judges = kept(("halves", *(tuple(h.items()) for h in halves)), lambda: [Compressors(h) for h in halves])
            langs, places, own = (c.to_pylist() for c in batch.columns)
            kept_ones = [judges[1 - k % 2].classify(t.encode())[0] == names[lang] for lang, k, t in zip(langs, places, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept_ones, pa.bool_())], ["lang", "place", "confirmed"])

    rows = [(n, k, t) for n, own in enumerate(texts.values()) for k, t in enumerate(own)]
    asked = spark.createDataFrame(rows, "lang int, place int, text string").repartition(shuffle_partitions(spark))
    told = {(r["lang"], r["place"]) for r in asked.mapInArrow(confirmed, "lang int, place int, confirmed boolean").filter("confirmed").collect()}
    found = {}
    for n, (lang, own) in enumerate(texts.items()):
        agreed = [t for k, t in enumerate(own) if (n, k) in told]
        found[lang] = agreed if 2 * len(agreed) > len(own) else own
    return found


def dictionaries(docs: DataFrame, sample: int = SAMPLE, snippet: int = SNIPPET, size: int = DICTIONARY, least: int = LEAST_TEXTS, most: int = MOST_LANGUAGES) -> dict[str, bytes]:
    """Dictionaries from ``docs`` (doc_id, text, lang), by language, most texts first.

    Two passes: one counts each language's texts, by map-side-combined sums; one draws ``sample``
    of each by a hash of doc_id and text, whatever ids are null or come again. Only a passage of
    ``snippet`` characters of the letters of each of these, from a hashed position in the whole
    text, goes to the driver: a bounded sample to fit on, not a limit on what is classified. Values of lang
    with fewer than ``least`` texts are no languages, and of more than ``most`` those with the most texts are learned.
    """
    known = docs.filter(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    common = known.groupBy("lang").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "lang").limit(most)
    counts = {r["lang"]: r["count"] for r in common.collect()}
    if not counts:
        return {}
    texts: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in sorted(drawn(known, counts, sample, snippet).collect(), key=lambda r: (r["place"], r["text"])):
        texts[r["lang"]].append(r["text"])
    return {lang: _joined(own, size) for lang, own in _agreeing(docs.sparkSession, texts, size).items() if own}


def drawn(known: DataFrame, counts: dict[str, int], sample: int = SAMPLE, snippet: int = SNIPPET) -> DataFrame:
    """lang, place and text (the passage) of at most ``sample`` rows of each language, those first by hash."""
    hashed = F.xxhash64("doc_id", "text")
    place = F.shiftrightunsigned(hashed, 11) / F.lit(2.0**53)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * sample / n))))[F.col("lang")]
    start = F.xxhash64("doc_id", "text", F.lit(1))
    spot = (F.pmod("start", F.greatest(F.length("text") - snippet + 1, F.lit(1))) + 1).cast("int")
    some = known.withColumn("place", place).filter(F.col("place") < share).select("lang", "place", letters().alias("text"), start.alias("start")).dropna()
    passages = some.select("lang", "place", F.substring("text", spot, F.lit(snippet)).alias("text"))
    # each task keeps its first ones of a language before they are shuffled
    first = Window.partitionBy("lang").orderBy("place", "text")
    return passages.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= sample).drop("rank")


def classified(docs: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row of ``docs`` (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = kept(("languages", *learned.items()), lambda: Compressors(learned))
        for batch in batches:
            rows = [(UNKNOWN, 0.0, True) if t is None else compressors.classify(t) for _, texts in strides(batch.column(1)) for t in texts]
            columns = zip(*rows) if rows else ([], [], [])
            types = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "lang_pred", "score", "rejected"])

    schema = f"doc_id {id_type}, lang_pred string, score double, rejected boolean"
    return docs.select("doc_id", letters().cast("binary")).mapInArrow(predicted, schema)


def accepted(docs: DataFrame, learned: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all their columns kept."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = kept(("languages", *learned.items()), lambda: Compressors(learned))
        for batch in batches:
            told = strides(batch.column(batch.num_columns - 1))
            keep = [t is not None and not compressors.classify(t)[2] for _, texts in told for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_())).select(range(batch.num_columns - 1))

    return docs.select("*", letters().cast("binary")).mapInArrow(passed, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_crc("doc_id") % 5 == 0
    learned = dictionaries(docs.filter(~held_out))
    return classified(docs, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
