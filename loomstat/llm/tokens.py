"""Token counts of a byte-level BPE by rank-synchronous array merging.

Texts are split into pre-tokens; the distinct ones of a batch are held as ragged numpy arrays
(all ids in one array, with the start of each sequence). Each round finds the lowest-ranked
adjacent pair of every sequence and applies it everywhere in that sequence at once, until no
sequence has a pair that merges. A sequence's surviving symbols are its tokens. Merging all
occurrences of the lowest-ranked pair from left to right gives what merging them one by one
gives, since a pair with a merged symbol always ranks below the merge that made the symbol.

Edge cases: a null or empty text has no bytes and no tokens; a special token's string inside a
text counts as one token; texts and pre-tokens of any length are counted whole; repeated rows
are counted each; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, strides, table
from .merging import RankMerger

#: Fixed value: how byte-level BPE splits text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens longer than this many characters are counted each time, not remembered.
LONGEST_KEPT = 48
#: Pre-tokens that each of a Python worker's two generations of memory holds (about 30 MB each).
MOST_KEPT = 200_000


class TokenCounter:
    """Counts tokens of texts; remembers the counts of pre-tokens seen lately."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.merger = RankMerger(said["model"])
        special = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _merged(self, words: list[str]) -> dict[str, int]:
        return dict(zip(words, self.merger.merged([w.encode() for w in words])[1].tolist()))

    def count(self, texts: list[str]) -> list[int]:
        split, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            split.append(self.find(text) if len(parts) == 1 else list(chain.from_iterable(map(self.find, parts))))
        if len(self.young) > MOST_KEPT:
            self.old, self.young = self.young, {}
        new = set().union(*split).difference(self.young)
        again = {w: self.old[w] for w in new if w in self.old}
        self.young.update(again)
        new.difference_update(again)
        self.young.update(self._merged([w for w in new if len(w) <= LONGEST_KEPT]))
        lookup = self.young
        if long := [w for w in new if len(w) > LONGEST_KEPT]:
            lookup = lookup | self._merged(long)
        return [n + sum(map(lookup.__getitem__, words)) for n, words in zip(extra, split)]


def token_counter(path: str) -> TokenCounter:
    """One for each Python worker, so that its tasks share what it remembers."""
    return kept(("counts", path), lambda: TokenCounter(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of ``docs`` (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer_path)
        for batch in batches:
            found: list[int] = []
            for _, texts in strides(batch.column(1)):
                found += counter.count(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return texts.mapInArrow(counted, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under byte_bpe_50k.json, against a limit of 1024 tokens."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
