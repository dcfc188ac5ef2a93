"""Exact quantiles of many groups by radix selection.

Values become longs in the same order. Their top 16 bits are counted by group; the counts tell in which
of these prefixes each wanted rank lies, and which rank it is there. Then the next 16 bits
are counted below the prefixes that were chosen, and so on: after four levels the value is told. All
groups and probabilities are narrowed together.

Equal values are counted together before anything is shuffled, so one heavy value is a row from each
task; all shuffles are by group and prefix, of counts, and below a prefix there are at most 65,536 of the
next: no task holds a group. The coarser counts come from the finer ones, which are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null
from ..functions.ordering import from_bits, with_bits

#: Bits of a level, and levels.
DIGIT, LEVELS = 16, 4


def _chosen(entries: Column, target: Column) -> Column:
    """The entry (key, cnt) in which the target's rank lies, as slot, key and the rank within; entries are in order."""
    start = F.struct(target["rank"].alias("rank"), F.lit(None).cast("long").alias("key"))

    def passed(held: Column, entry: Column) -> Column:
        done = held["key"].isNotNull()
        here = ~done & (held["rank"] < entry["cnt"])
        return F.struct(
            F.when(done | here, held["rank"]).otherwise(held["rank"] - entry["cnt"]).alias("rank"),
            F.when(here, entry["key"]).otherwise(held["key"]).alias("key"),
        )

    return F.aggregate(entries, start, passed, lambda held: F.struct(target["slot"].alias("slot"), held["key"].alias("key"), held["rank"].alias("rank")))


def _narrowed(df: DataFrame) -> DataFrame:
    """grp, n, prefix and targets: the chosen keys of each row's targets, and for each of them the ranks sought below it."""
    chosen = df.select("grp", "n", F.transform("targets", lambda t: _chosen(F.col("entries"), t)).alias("chosen"))
    keys = F.array_distinct(F.transform("chosen", lambda c: c["key"]))
    below = lambda k: F.transform(F.filter("chosen", lambda c: c["key"] == k), lambda c: F.struct(c["slot"].alias("slot"), c["rank"].alias("rank")))
    return chosen.select("grp", "n", F.inline(F.transform(keys, lambda k: F.struct(F.coalesce(k, F.lit(0)).alias("prefix"), below(k).alias("targets")))))


def radix_quantiles(long: DataFrame, probabilities: Iterable[float], by: Iterable[str], times: str | None = None) -> DataFrame:
    """The columns ``by`` and q: an array with the linearly interpolated quantile of ``value`` for each probability.

    Nulls and NaN are left out, groups of them alone too. Infinities are values; between opposite ones a quantile is null.
    A row's value counts as often as its column ``times`` tells, if one is named.
    """
    probabilities, by = list(probabilities), list(by)
    # one key for the group, which is never null, though its parts may be: joins and counts on it share their partitioning
    group = F.struct(*(F.col(c).alias(f"by{k}") for k, c in enumerate(by))) if by else F.struct(F.lit(0).alias("by0"))
    weight = F.col(times).cast("long") if times else F.lit(1).cast("long")
    plain = long.select(group.alias("grp"), F.col("value").cast("double").alias("value"), weight.alias("times")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    values = with_bits(plain, "value", "bits")
    counts = [values.groupBy("grp", F.coalesce("bits", F.lit(0)).alias("key")).agg(F.sum("times").alias("cnt"))]
    for _ in range(LEVELS - 1):  # from all bits to the top ones
        counts.append(counts[-1].groupBy("grp", F.shiftright("key", DIGIT).alias("key")).agg(F.sum("cnt").alias("cnt")))

    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    targets = [F.struct(F.lit(2 * k + side).alias("slot"), end(place(p)).cast("long").alias("rank")) for k, p in enumerate(probabilities) for side, end in enumerate((F.floor, F.ceil))]
    entries = F.array_sort(F.collect_list(F.struct("key", "cnt"))).alias("entries")
    state = _narrowed(counts.pop().groupBy("grp").agg(entries, F.sum("cnt").alias("n")).withColumn("targets", F.array(*targets)))
    while counts:
        finer = counts.pop().withColumn("prefix", F.shiftright("key", DIGIT))
        met = finer.join(state, ["grp", "prefix"])
        state = _narrowed(met.groupBy("grp", "prefix").agg(entries, F.first("n").alias("n"), F.first("targets").alias("targets")))

    ends = state.select("grp", "n", F.transform("targets", lambda t: F.struct(t["slot"].alias("slot"), from_bits(F.col("prefix")).alias("v"))).alias("ends"))
    both = ends.groupBy("grp", "n").agg(F.transform(F.array_sort(F.flatten(F.collect_list("ends"))), lambda s: s["v"]).alias("ends"))

    def value(k: int, p: float) -> Column:
        a, b = F.col("ends")[2 * k], F.col("ends")[2 * k + 1]
        part = place(p) - F.floor(place(p))
        return F.when(a == b, a).otherwise(nan_to_null((1.0 - part) * a + part * b))

    return both.select(*(F.col("grp")[f"by{k}"].alias(c) for k, c in enumerate(by)), F.array(*(value(k, p) for k, p in enumerate(probabilities))).alias("q"))
