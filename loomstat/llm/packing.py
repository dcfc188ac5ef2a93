"""Packing by power-of-two decomposition.

Each document's tokens are cut into pieces of ``seq_len`` (a power of two) and, for the rest,
into pieces whose lengths are the powers of two in the rest's binary form, longest first.
Each piece is a sequence by itself: no sequence crosses documents, none needs padding, and
sequences of one length form a bucket from which batches are drawn.

There is no shuffle: a task tokenizes its own documents and emits their pieces.

Edge cases: a null or empty text packs as the end-of-document id alone; repeated rows are
packed once each, with sequences of their own; a null doc_id stays null; an empty table
gives no pieces; other columns of the input are not carried.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, strides, table
from .merging import RankMerger

#: Words longer than this many bytes are tokenized each time, not remembered.
LONGEST_KEPT = 48
#: Words that each of a Python worker's two generations of memory holds (about 30 MB each).
MOST_KEPT = 200_000

#: Bytes of text tokenized in one go.
STRIDE = 2 << 20


def _classes() -> np.ndarray:
    """1: ASCII lower-case letters; 2: other ASCII but white space and the apostrophe; 0: the rest."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = 2
    kinds[ord("a") : ord("z") + 1] = 1
    kinds[ord("'")] = 0
    return kinds


def _is_plain(word: bytes) -> bool:
    """Whether the tokenizer takes the word as it is, in one piece: lower-case Latin letters in composed form only."""
    if word.isalpha():  # ASCII letters only
        return word.islower()
    text = word.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0250" and text == text.lower() and unicodedata.is_normalized("NFC", text)


class WordTokenizer:
    """Ids of texts under a lower-casing tokenizer that splits at white space and between ASCII
    letters and other ASCII signs (but for the apostrophe), and never merges across.

    Under such a tokenizer a text's ids are the ids of those parts, one after the other, so a
    part that comes again is not tokenized again. New words of Latin letters merge together in
    arrays, which gives the library's ids; all else goes to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.kinds = _classes()
        with open(path, encoding="utf-8") as file:
            self.merger = RankMerger(json.load(file)["model"])

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = {}
        plain, other = [], []
        for w in words:
            (plain if _is_plain(w) else other).append(w)
        for at in range(0, len(plain), 1 << 14):
            some = plain[at : at + (1 << 14)]
            ids, sizes = self.merger.merged(some)
            data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            found.update((w, data[a:b]) for w, a, b in zip(some, [0, *ends], ends))
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            texts = [w.decode("utf-8", "replace") for w in some]
            for w, e in zip(some, self.library.encode_batch_fast(texts, add_special_tokens=False)):
                found[w] = np.array(e.ids, "<u4").tobytes()
        return found

    def _split(self, text: bytes) -> list[bytes]:
        if b"<|" in text:  # may hold a special token, whose letters' case counts
            return text.split()
        own, signs = np.frombuffer(text, np.uint8), np.frombuffer(text.lower(), np.uint8)
        kinds = self.kinds[signs]
        cuts = np.flatnonzero((kinds[1:] ^ kinds[:-1]) == 3) + 1  # 1 beside 2
        # a capital and marks after it are composed before the tokenizer lowers them: such a word keeps its case
        composed = bool((((own[:-1] - 65) < 26) & (own[1:] > 127)).any())
        words = np.insert(own if composed else signs, cuts, 32).tobytes().split()
        return [w.lower() if w.isascii() else w for w in words] if composed else words

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self._split(t) for t in texts]
        if len(self.young) > MOST_KEPT:
            self.old, self.young = self.young, {}
        new = set().union(*split).difference(self.young)
        if self.old:
            again = {w: ids for w, ids in zip(new, map(self.old.get, new)) if ids}
            self.young.update(again)
            new.difference_update(again)
        self.young.update(self._learn([w for w in new if len(w) <= LONGEST_KEPT]))
        lookup = self.young
        if long := [w for w in new if len(w) > LONGEST_KEPT]:
            lookup = lookup | self._learn(long)
        return [b"".join(map(lookup.__getitem__, words)) for words in split]


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that its tasks share what it remembers."""
    return kept(("words", path), lambda: WordTokenizer(path))


def piece_lengths(n: int, seq_len: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: ``seq_len`` as often as it fits, then n's lower bits."""
    rest = n % seq_len
    return [seq_len] * (n // seq_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """Pieces of all documents: one row per piece, each a sequence by itself.

    ``docs`` has doc_id and text. Columns: doc_id, start, length, ids_crc32, doc_tokens,
    [ids array<int>,] sequence_id, offset (always 0) and bucket (log2 of the length). Write
    them ``partitionBy("bucket")`` to draw batches of equal lengths.

    sequence_id is the position of the piece in its task's output next to the task's number,
    so that no numbering pass over the corpus is needed; it is the same when a task is rerun.
    """
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError(f"seq_len must be a power of two, not {seq_len}")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            ids = batch.column(0)
            for first, texts in strides(batch.column(1), STRIDE):
                row, start, length, crc, total, own = [], [], [], [], [], []
                for k, doc in enumerate(tokenizer.encode([t or b"" for t in texts]), first):
                    doc += end
                    n, at = len(doc) // 4, 0
                    view = memoryview(doc)
                    for size in piece_lengths(n, seq_len):
                        piece = view[4 * at : 4 * (at + size)]
                        row.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            own.append(piece)
                        at += size
                columns = [ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(np.frombuffer(b"".join(own), np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return (
        docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(pieces, schema)
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
        .withColumn("bucket", F.log2("length").cast("int"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens; the tokenizer's file is a parameter of ``pack``."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
