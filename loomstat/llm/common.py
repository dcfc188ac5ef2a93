"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: What lies between words.
GAP = r"[\x20\x09-\x0D]+"

#: Bytes of text held as Python objects in one go, and handed to Python in one batch.
STRIDE, BATCH = 1 << 20, 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_CLEANING = "spark.cleaner.referenceTracking.cleanCheckpoints"

_ROW_BITS = 33  # monotonically_increasing_id: partition in the upper bits, row in the lower 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``; a temporary
    one is set only where the session names none and all tasks run in this process (tests).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomstat-checkpoint-"))
    settings = context._jsc.sc().conf()
    before = settings.get(_CLEANING, "false")
    settings.set(_CLEANING, "true")  # told as a checkpoint is made: its files go with the last reference to it
    try:
        return df.checkpoint(eager=True)
    finally:
        settings.set(_CLEANING, before)


def released(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files and checkpoints of steps that nothing refers to any more.

    It learns of them from the driver's garbage collector, which may not run for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_crc(doc_id: str | Column) -> Column:
    """crc32 of a document id as text; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")))


def text_key() -> Column:
    """A 64-bit hash of a row's text; null and empty are alike."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row but its text, never null."""
    others = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes if c != "text"]
    return F.xxhash64(*others, *(c.isNull() for c in others))


def distinct_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` lists, once each, with all their columns and those that ``chosen`` carries.

    ``chosen`` starts with row_key and text_key, and has each pair once. Rows equal in both, so in all columns, are
    dropped before the shuffle as well as after it; the join then finds the rows in place.
    """
    keys = [fresh(docs, "row_key"), fresh(docs, "text_key")]
    once = docs.withColumns(dict(zip(keys, (row_key(docs), text_key())))).dropDuplicates(keys)
    return once.join(chosen.toDF(*keys, *chosen.columns[2:]), keys).drop(*keys)


def globally_ranked(df: DataFrame, keys: list[str], rank: str, partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in the order of ``keys`` over the whole table.

    A range shuffle sorts the rows into partitions of like size, whatever the keys' skew
    (add a hash to ``keys`` so that no value holds many rows), and is checkpointed; only one
    count per partition goes to the driver. No task ever holds a group.
    """
    spark = df.sparkSession
    place = fresh(df, "place")
    ordered = df.repartitionByRange(partitions or shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    ordered = checkpointed(ordered.withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, _ROW_BITS).cast("int")
    row = F.col(place).bitwiseAND((1 << _ROW_BITS) - 1)
    counts = {r[0]: r[1] for r in ordered.groupBy(part.alias("part")).count().collect()}
    before, offsets = 0, []
    for k in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(k, 0)
    start = F.element_at(F.lit(offsets or [0]).cast("array<bigint>"), part + 1)
    return ordered.withColumn(rank, row + start).drop(place)


def prepared(spark: SparkSession) -> SparkSession:
    """Have texts handed to Python in batches of BATCH bytes, unless the session has a limit of its own.

    Spark's default of 64 MiB a batch, on both sides of each task, is much where all rows are texts. The queries and
    the pipeline's stages ask for it; operators leave the session as they find it.
    """
    if spark.conf.get(_BATCH_SETTING, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH)
    return spark


_kept: dict = {}
#: Hands freed memory of the C library back to the system, where it can.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: None)


def given_back() -> None:
    """Give the memory that a Python worker has freed back to the system: the allocators would keep it for the next batch."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def kept(key, make):
    """What ``make`` returned for ``key``, from one task of a Python worker to the next, as long as no other key is asked for.

    So what an operator remembers goes when another operator comes to the same worker.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        given_back()
        _kept[key] = make()
    return _kept[key]


def strides(column: pa.Array, most: int = STRIDE) -> Iterator[tuple[int, list]]:
    """The texts of a column in stretches of about ``most`` bytes, each with its first row: few are held as Python objects at a time."""
    start = total = 0
    for k, size in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        total += size
        if total >= most:
            yield start, column.slice(start, k + 1 - start).to_pylist()
            start, total = k + 1, 0
    if start < len(column):
        yield start, column.slice(start).to_pylist()
    given_back()
