"""Checks of inputs: required columns, unique keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MissingColumnsError(ValueError):
    """A step's input lacks columns it needs."""


class DuplicateKeyError(ValueError):
    """A key that should be unique is not, or is null."""


def require_columns(df: DataFrame, columns: Iterable[str], step: str) -> DataFrame:
    """``df`` itself, or an error that lists what is missing and what is there. Runs no job."""
    if missing := [c for c in columns if c not in df.columns]:
        raise MissingColumnsError(f"{step}: missing {missing}; available {df.columns}")
    return df


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with n rows and n_surplus beyond the first."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").withColumn("n_surplus", F.col("n") - 1)


def key_report(df: DataFrame, *key: str) -> DataFrame:
    """One row: rows, distinct keys, keys that repeat, surplus rows, rows with a null in the key."""
    null_key = F.greatest(*(F.col(c).isNull().cast("long") for c in key)) if len(key) > 1 else F.col(key[0]).isNull().cast("long")
    return (
        df.groupBy(*key)
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count("*").alias("n_keys"),
            F.count_if(F.col("n") > 1).alias("n_duplicate_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_surplus"),
            F.coalesce(F.sum(null_key * F.col("n")), F.lit(0)).alias("n_null_keys"),
        )
    )


def check_unique(tables: dict[str, DataFrame], key: str) -> None:
    """J02 over several tables, in one job: raise if a key repeats or is null, naming the first ten. Tables in buckets of the key are not shuffled."""
    found = None
    for name, df in tables.items():
        bad = df.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
        bad = bad.select(F.lit(name).alias("dataset"), F.col(key).cast("string").alias("key"), "n")
        found = bad if found is None else found.unionByName(bad)
    if found is not None and (rows := found.limit(10).collect()):
        raise DuplicateKeyError(f"{key} is not unique: " + ", ".join(f"{r['dataset']} {r['key']} x{r['n']}" for r in rows))
