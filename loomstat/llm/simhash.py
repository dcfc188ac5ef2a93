"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Each
distinct fingerprint emits all variants within half the radius; two fingerprints lie within
the radius exactly if they share a variant. The variants are shuffled; those that meet are at
most ``1 + 64`` distinct fingerprints (for a radius of 2) which all link to each other, so a
chain through them, in order, keeps every connection without emitting all their pairs. Each
chain link is verified, and links are deduplicated before components are found.

Equal fingerprints are brought together first, by a map-side-combined minimum, so groups of
exact copies of any size cost one row each from there on.

Edge cases: a null, empty or blank text has fingerprint zero, linked like any other; fewer
words than a shingle has make one shingle of what there is; a null doc_id takes part but is
never a component's id unless all ids there are null; repeated rows share fingerprint and
component; an empty table gives no rows; other columns, whatever their names, are not carried
by ``fingerprints`` and are kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, distinct_rows, kept, row_key, shuffle_partitions, strides, table, text_key
from .components import components

BITS = 64
SEED = 42
#: Hashes whose bits are unpacked in one go.
STRIDE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return majority(np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit ``hashes`` have, as a signed 64-bit integer."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STRIDE):
        some = hashes[at : at + STRIDE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, row_hash, text_hash and fp (signed 64-bit fingerprint) of each row of ``docs``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("fingerprints", dict)
        for batch in batches:
            found = [fingerprint(t or b"", shingle) for _, texts in strides(batch.column(3)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], ["doc_id", "row_hash", "text_hash", "fp"])

    texts = docs.select("doc_id", row_key(docs).alias("row_hash"), text_key().alias("text_hash"), F.col("text").cast("binary"))
    return texts.mapInArrow(made, f"doc_id {id_type}, row_hash long, text_hash long, fp long")


def _masks(half: int) -> list[int]:
    found = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b) between the distinct fingerprints in ``prints``' column fp.

    Not every pair within the radius is listed, but every such pair is connected.
    """
    if radius < 0 or radius % 2:
        raise ValueError(f"radius must be even, not {radius}: half of it is searched from both ends")
    variants: Column = F.array(*(F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in _masks(radius // 2)))
    met = Window.partitionBy("variant").orderBy("fp")
    # a row makes many: they are few now, and may lie in few tasks
    spread = prints.select("fp").repartition(shuffle_partitions(prints.sparkSession), "fp")
    return (
        spread.select("fp", F.explode(variants).alias("variant"))
        .select(F.lag("fp").over(met).alias("a"), F.col("fp").alias("b"))
        .filter(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .distinct()
    )


def classes(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with root (a fingerprint that names the group) and component_id.

    ``prints`` is read more than once: give it checkpointed.
    """
    lowest = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    stars = components(links(lowest, radius)).select(F.col("child").alias("fp"), F.col("parent").alias("root"))
    rooted = lowest.join(stars, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root")
    return prints.join(named, "fp")


def deduplicated(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (nulls last), all its columns kept.

    Of rows equal in doc_id and text one stays, by a hash of their other columns.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "text_hash")).alias("first")
    chosen = classes(prints, radius).groupBy("root").agg(first).select("first.row_hash", "first.text_hash")
    return distinct_rows(docs, chosen).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles over all documents, linked at 2 or fewer differing bits."""
    prints = checkpointed(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fp"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes(prints).select("doc_id", hexed.alias("fingerprint"), "component_id")
