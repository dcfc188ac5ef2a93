"""CSV and Parquet in and out, by paths that any Hadoop file system may hold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog
from ..functions.columns import nan_to_null
from ..operators.quality import MissingColumnsError, check_unique

#: Texts that a CSV cell holds in place of a number.
MISSING_TEXTS = ("", "NA", "NaN", "nan", "N/A", "NULL", "null")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, wherever Hadoop finds it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def require_path(spark: SparkSession, path: str, step: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"{step}: {path} is not there")
    return path


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV file; reads its first line."""
    return spark.read.csv(path, header=True, inferSchema=False).columns


def list_columns(spark: SparkSession, folder: str, catalog: Catalog) -> dict[str, list[str] | None]:
    """Each dataset's columns, or None where its file is absent."""
    paths = {d.name: f"{folder}/{d.file}" for d in catalog.datasets}
    return {name: header(spark, p) if exists(spark, p) else None for name, p in paths.items()}


def read_csv(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """The columns, in that order, as doubles; missing-value texts and NaN become null.

    The file's header sets the order in which fields are read, so that columns may stand in any
    order; only those asked for are parsed. A cell that is neither a number nor a missing-value
    text fails the job instead of turning null unseen.
    """
    columns = list(columns)
    there = header(spark, require_path(spark, path, "scan"))
    if missing := [c for c in columns if c not in there]:
        raise MissingColumnsError(f"{path}: missing {missing}; available {there}")
    texts = spark.read.csv(path, header=True, enforceSchema=False, schema=T.StructType([T.StructField(c, T.StringType()) for c in there]))
    number = lambda c: nan_to_null(F.when(~F.trim(c).isin(*MISSING_TEXTS), F.trim(c).cast("double")))
    return texts.select(*(number(c).alias(c) for c in columns))


def read_datasets(spark: SparkSession, folder: str, catalog: Catalog, validate: bool = True) -> dict[str, DataFrame]:
    """All datasets of the catalogue, lazily; with ``validate``, their keys are checked in one job."""
    tables = {d.name: read_csv(spark, f"{folder}/{d.file}", (catalog.key, *d.columns)) for d in catalog.datasets}
    if validate:
        check_unique(tables, catalog.key)
    return tables


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stage's Parquet output, or one from elsewhere: NaN becomes null."""
    df = spark.read.parquet(require_path(spark, path, "stage input"))
    return df.withColumns({c: nan_to_null(F.col(c)).cast(kind) for c, kind in df.dtypes if kind in ("double", "float")})


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """A table in ``buckets`` of its key, each sorted: joins and counts by the key with tables in as many buckets shuffle nothing.

    It is shuffled once, here, so that a bucket is one file. The number of buckets goes with the largest of the
    tables that are to meet: its bytes over those that a task should hold.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def write_table(df: DataFrame, path: str, csv: str | None = None) -> DataFrame:
    """Parquet, and CSV beside it if a path is given; returns the table as written."""
    df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    if csv:
        written.write.mode("overwrite").option("header", True).csv(csv)
    return written


def snapshot(df: DataFrame, folder: str, number: str, label: str) -> DataFrame:
    """The table after a decision; later steps read it instead of computing it again."""
    return write_table(df, f"{folder}/snapshot_decision_{number}_{label}")


def write_small(df: DataFrame, path: str) -> None:
    """A result of a few rows, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A report, by Hadoop's file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def preview(spark: SparkSession, folder: str, rows: int = 10) -> dict[str, list[dict] | str]:
    """The first rows of each CSV file in a folder (any case of the ending), or its error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(require_path(spark, folder, "preview"))
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    found: dict[str, list[dict] | str] = {}
    for name in sorted(f.getPath().getName() for f in files):
        if name.lower().endswith(".csv"):
            try:
                found[name] = [r.asDict() for r in spark.read.csv(f"{folder}/{name}", header=True).limit(rows).collect()]
            except Exception as error:  # one bad file does not hide the others
                found[name] = f"{type(error).__name__}: {error}"
    return found
