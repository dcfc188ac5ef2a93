"""Frequencies and means by label or bin."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import nan_to_null
from ..functions.moments import QUARTILES, exact_quantiles
from .longform import known_bytes, to_long
from .profile import IN_MEMORY
from .selection import radix_quantiles


def frequency(df: DataFrame, label: str) -> DataFrame:
    """Rows by label, nulls left out, most frequent first."""
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def code_frequency(df: DataFrame, code: str) -> DataFrame:
    """Rows by code, nulls counted and last."""
    return df.groupBy(code).agg(F.count("*").alias("n")).orderBy(F.col(code).asc_nulls_last())


def label_shares(df: DataFrame, label: str) -> DataFrame:
    """Rows by label with their share of all rows, of which those without a label are a part too."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).filter(F.col(label).isNotNull()).select(label, "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def group_means(df: DataFrame, features: Iterable[str], label: str, labels: Iterable[str]) -> DataFrame:
    """A row for each feature with its mean in each label's group; rows without a label are left out."""
    long = to_long(df.filter(F.col(label).isNotNull()), features, [label])
    return long.groupBy("variable").pivot(label, list(labels)).agg(F.avg("value"))


def group_diff_pct(means: DataFrame, a: str, b: str, places: int = 3) -> DataFrame:
    """(a - b) / b in percent, of means rounded first."""
    rounded = means.withColumns({a: F.bround(a, places), b: F.bround(b, places)})
    return rounded.withColumn("diff_pct", C.relative_diff_pct(F.col(a), F.col(b)))


def _quartiles_of_sets(plain: DataFrame, features: int, sets: dict[int, str | None]) -> DataFrame:
    """For each group of each set, by set, its labels and the feature's position, q: the exact quartiles by radix selection.

    Values are counted by all labels together first; the sets take these counts.
    """
    labels = [label for label in sets.values() if label is not None]
    long = plain.select(*labels, F.posexplode(F.array(*(F.col(f"value{k}") for k in range(features)))).alias("pos", "value")).filter(F.col("value").isNotNull())
    counts = long.groupBy(*labels, "pos", "value").agg(F.count("*").alias("times"))
    kept = lambda c, own: F.col(c) if c == own else F.lit(None).cast(plain.schema[c].dataType)
    groups = F.array(*(F.struct(F.lit(n).cast("long").alias("set"), *(kept(c, own).alias(c) for c in labels)) for n, own in sets.items()))
    return radix_quantiles(counts.select("pos", "value", "times", F.inline(groups)), QUARTILES, ["set", *labels, "pos"], "times")


def label_sets(df: DataFrame, features: Iterable[str], labels: Iterable[str], quartiles: bool = True, in_memory: int = IN_MEMORY) -> DataFrame:
    """What each feature is over all rows and by each of several labels, as grouping sets.

    label_set (``all`` or the label's column), label, variable, n_rows, n_valid, mean, std, min and max, and with ``quartiles``
    q1, median and q3, exact: of small inputs in the same scan and shuffle, where one task holds the distinct values of all features;
    of larger ones by radix selection, with the same results. Rows without a label are a group of their own,
    whose label is null; that of ``all`` is null too, and label_set tells them apart.
    """
    features, labels = list(features), list(labels)
    own_names = [f"label{k}" for k in range(len(labels))]
    plain = df.select(*(F.col(c).alias(o) for c, o in zip(labels, own_names)), *(nan_to_null(F.col(c).cast("double")).alias(f"value{k}") for k, c in enumerate(features)))
    by_radix = quartiles and known_bytes(plain) * len(features) > in_memory

    def measured(k: int, name: str) -> Column:
        value = F.col(f"value{k}")
        parts = [F.lit(name).alias("variable"), F.count(value).alias("n_valid"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
        if quartiles and not by_radix:
            q = exact_quantiles(f"value{k}")
            parts += [nan_to_null(F.get(q, F.lit(i))).alias(n) for i, n in enumerate(("q1", "median", "q3"))]
        return F.struct(*parts)

    # a label's bit is 0 in its own set, the first label's bit the highest
    whole = (1 << len(labels)) - 1
    sets = {whole: None} | {whole - (1 << (len(labels) - 1 - k)): o for k, o in enumerate(own_names)}
    made = plain.groupingSets([[F.col(o)] if o else [] for o in sets.values()], *own_names).agg(F.grouping_id().alias("set"), F.count("*").alias("n_rows"), F.array(*(measured(k, c) for k, c in enumerate(features))).alias("parts"))
    name, label = F.lit("all"), F.lit(None).cast("string")
    for c, (n, own) in zip(labels, list(sets.items())[1:]):
        name, label = F.when(F.col("set") == n, F.lit(c)).otherwise(name), F.when(F.col("set") == n, F.col(own).cast("string")).otherwise(label)
    if not by_radix:
        return made.select(name.alias("label_set"), label.alias("label"), "n_rows", F.inline("parts"))
    rows = made.select("set", *own_names, name.alias("label_set"), label.alias("label"), "n_rows", F.posexplode("parts").alias("pos", "part")).alias("m")
    q = _quartiles_of_sets(plain, len(features), sets).alias("q")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"q.{c}")) for c in ("set", *own_names, "pos")]
    return rows.join(q, same, "left").select("label_set", "label", "n_rows", "part.*", *(F.get("q.q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))))
