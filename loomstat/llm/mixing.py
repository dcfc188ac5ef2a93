"""Mixing sources to target weights by systematic sampling.

Within a source each document expects ``target / source size`` copies. The running sum of the
expected copies, shifted by one random offset for the source, emits a document once for each
integer that it crosses. Documents run in order of size (by its length and first two digits,
then by hash), so that each stretch of sizes gets its share and a source's taken words miss
its target by about its largest document at most. No document gets more than ``most`` copies.

The running sum is the rate times the document's place in its source, and that place comes from
one range shuffle over (source, size, hash), which splits sources of any size evenly.

Edge cases: a null or blank text has size 0 and is emitted like any other, at no words; a null
source is a source of its own, last in order; if all sizes are 0, all targets are 0; repeated
rows count each (equal rows may swap their copies); a null doc_id hashes as the empty text, and
rows of one id go by size and text; an empty table gives no rows; other columns, whatever their
names, are not carried by ``copies`` and are kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, checkpointed, distinct_rows, fresh, globally_ranked, row_key, shuffle_partitions, table, text_key

#: Weights of the sources in order of code points, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all.
BUDGET = 1.5
#: Copies of a document at most; also a target against its source's size.
MOST = 2
SEED = "mix"
#: Sources at most whose targets are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: Sources that one task ranks, about.
SOURCES_IN_A_TASK = 100_000


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``sources`` (unnamed, source, source_size, ...; one row each) with target: shares of ``budget`` times all sizes by weight; none above ``most`` times its size.

    A source is full if its limit is no more than its weight's share of what the full ones leave to
    the others. Filling some raises the shares of the others, until none more gets full: each round
    is one sum over the sources, and the sums alone go to the driver.
    """
    parts = min(shuffle_partitions(sources.sparkSession), 1 + sources.count() // SOURCES_IN_A_TASK)
    ranked = globally_ranked(sources, ["unnamed", "source"], "nth", parts)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    weighed = checkpointed(ranked.withColumn("weight", weight))
    limit, weight = F.lit(float(most)) * F.col("source_size"), F.col("weight")
    sums = lambda *columns: [float(v or 0) for v in weighed.agg(*map(F.sum, columns)).first()]
    size, still_open = sums("source_size", "weight")
    left = everything = budget * size
    while True:
        full = limit * still_open <= left * weight
        taken, others = sums(F.when(full, limit), F.when(~full, weight))
        if others >= still_open:
            break
        left, still_open = everything - taken, others
    share = F.lit(left) * weight / F.lit(still_open or 1.0)
    return weighed.withColumn("target", F.when(full, limit).otherwise(share)).drop("nth", "weight")


def _hash60(value: Column) -> Column:
    """The first 60 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def copies(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: str = SEED, carried: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, text_hash, size, source_size, target and copies of each row of ``docs`` (doc_id, text, source), and its ``carried`` columns.

    Sources stay a table, however many they are; beyond BROADCAST_SOURCES the join with it
    leaves a large source to adaptive execution.
    """
    size = F.col("size").cast("string")
    slim = docs.select("doc_id", "source", word_count().alias("size"), text_key().alias("text_hash"), *carried).select(
        "doc_id",
        "text_hash",
        "source",
        "size",
        F.col("source").isNull().alias("unnamed"),
        (F.length(size) * 100 + F.substring(size, 1, 2).cast("int")).alias("bin"),
        _hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("hash"),
        *carried,
    )
    slim = checkpointed(slim)
    # rows that still tie are alike in all that a mix looks at
    ranked = globally_ranked(slim, ["unnamed", "source", "bin", "hash", "doc_id", "size", "text_hash", *carried], "rank")
    own = checkpointed(ranked.groupBy("unnamed", "source").agg(F.sum("size").alias("source_size"), F.min("rank").alias("before")))
    told = targets(own, weights, budget, most).select(F.col("source").alias("named"), "source_size", "target", "before")
    told = F.broadcast(told) if own.count() <= BROADCAST_SOURCES else told
    place = F.col("rank") - F.col("before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.nullif("source_size", F.lit(0))).otherwise(0.0)
    offset = _hash60(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))) / F.lit(2.0**60)
    copy = F.floor(F.col("rate") * (F.col("place") + 1) + F.col("offset")) - F.floor(F.col("rate") * F.col("place") + F.col("offset"))
    return (
        ranked.join(told, F.col("source").eqNullSafe(F.col("named")))
        .select("doc_id", "text_hash", "size", "source_size", "target", place.alias("place"), rate.alias("rate"), offset.alias("offset"), *carried)
        .select("doc_id", "text_hash", "size", "source_size", "target", copy.cast("int").alias("copies"), *carried)
    )


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with each row emitted as often as the mix takes it, all columns kept."""
    # rows equal in all columns are interchangeable: they share their copies out
    key = fresh(docs, "row_key")
    told = copies(docs.withColumn(key, row_key(docs)), **parameters, carried=(key,))
    taken = told.filter("copies > 0").groupBy(key, "text_hash").agg(F.sum("copies").cast("int").alias("copies"))
    times = fresh(docs, "times_taken")
    found = distinct_rows(docs, taken.withColumnRenamed("copies", times))
    return found.withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, at 150% of all words, sources weighing 5, 2, 1."""
    found = copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM docs GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, source IS NULL, source) AS k,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM sources),
summed AS (
  SELECT *, budget - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM ranked),
stops AS (
  SELECT *, min(CASE WHEN 2 * source_size * open_w > remaining * w THEN k END) OVER () AS first_open FROM summed),
targets AS (
  SELECT s.source, s.source_size,
         CASE WHEN s.first_open IS NULL OR s.k < s.first_open THEN CAST(2 * s.source_size AS DOUBLE)
              ELSE f.remaining::DOUBLE * s.w / f.open_w END AS target
  FROM stops s LEFT JOIN summed f ON f.k = s.first_open),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.source
           ORDER BY length(CAST(d.size AS VARCHAR)) * 100 + CAST(substr(CAST(d.size AS VARCHAR), 1, 2) AS INT), d.h, d.doc_id) - 1 AS place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 15) AS BIGINT)::DOUBLE / 1152921504606846976.0::DOUBLE AS u
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate * (place + 1) + u) - floor(rate * place + u)) AS BIGINT) AS taken
FROM placed
"""
