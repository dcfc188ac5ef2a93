"""Patterns of missingness: each row's missing cells as a bitmap, counted once; other results come from the table of patterns.

There are as many patterns as rows differ in what they miss, mostly few; the rows are read once, and only counts by pattern are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of one word of a bitmap.
WORD = 63


class Patterns:
    """``table`` (words array<long>, n): how many rows miss which of ``columns``. NaN is missing too."""

    def __init__(self, table: DataFrame, columns: Iterable[str]):
        self.table, self.columns = table, list(columns)

    @classmethod
    def of(cls, df: DataFrame, columns: Iterable[str]) -> Patterns:
        columns, kinds = list(columns), dict(df.dtypes)
        absent = {c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull() for c in columns}
        bit = lambda k, c: F.when(absent[c], F.lit(1 << k % WORD)).otherwise(F.lit(0)).cast("long")
        words = [reduce(lambda a, b: a.bitwiseOR(b), (bit(k, c) for k, c in enumerate(columns[first : first + WORD], first))) for first in range(0, len(columns), WORD)]
        names = [f"word{k}" for k in range(len(words))]
        counts = df.select(*(w.alias(n) for w, n in zip(words, names))).groupBy(*names).agg(F.count("*").alias("n"))
        return cls(counts.select(F.array(*names).alias("words"), "n"), columns)

    def misses(self, column: str) -> Column:
        """Whether a pattern's rows miss the column."""
        k = self.columns.index(column)
        return F.col("words")[k // WORD].bitwiseAND(F.lit(1 << k % WORD)) != 0

    def _sum(self, condition: Column | None = None) -> Column:
        rows = F.col("n") if condition is None else F.when(condition, F.col("n")).otherwise(0)
        return F.coalesce(F.sum(rows), F.lit(0))

    def named(self) -> DataFrame:
        """pattern (1 where a column is missing, in order), missing (their names) and n, most frequent first."""
        flags = F.array(*(F.when(self.misses(c), F.lit("1")).otherwise(F.lit("0")) for c in self.columns))
        names = F.array(*(F.when(self.misses(c), F.lit(c)) for c in self.columns))
        told = self.table.select(F.array_join(flags, "").alias("pattern"), F.array_join(names, ",").alias("missing"), "n")
        return told.orderBy(F.desc("n"), "pattern")

    def missing_table(self, high_pct: float = 40.0) -> DataFrame:
        """As ``missing.missing_table``."""
        parts = [F.struct(F.lit(k).alias("k"), F.lit(c).alias("variable"), self._sum(self.misses(c)).alias("missing_count"), self._sum().alias("rows")) for k, c in enumerate(self.columns)]
        table = self.table.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))
        pct = F.bround(F.coalesce(F.try_divide(F.col("missing_count") * 100.0, F.col("rows")), F.lit(0.0)), 2)
        out = table.select("k", "variable", "missing_count", pct.alias("missing_pct"), (F.col("rows") - F.col("missing_count")).alias("present_count"))
        return out.withColumn("is_high", F.col("missing_pct") > high_pct).orderBy(F.desc("missing_pct"), "k").drop("k")

    def complete_cases(self, sets: dict[str, Iterable[str]]) -> DataFrame:
        """As ``missing.complete_cases``."""
        sets = {name: list(columns) for name, columns in sets.items()}
        whole = lambda columns: ~reduce(lambda a, b: a | b, map(self.misses, columns))
        parts = [
            F.struct(F.lit(name).alias("column_set"), F.lit(len(columns)).cast("long").alias("n_columns"), self._sum(whole(columns)).alias("n_complete"), self._sum().alias("n_rows"))
            for name, columns in sets.items()
        ]
        return self.table.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))

    def _held(self, readings: Iterable[str]) -> Column:
        return reduce(lambda a, b: a + b, ((~self.misses(c)).cast("int") for c in readings))

    def readings_histogram(self, readings: Iterable[str]) -> DataFrame:
        """As ``missing.readings_histogram``."""
        return self.table.groupBy(self._held(readings).alias("n_readings")).agg(F.sum("n").alias("n_rows")).orderBy("n_readings")

    def coverage(self, readings: Iterable[str]) -> DataFrame:
        """As ``missing.coverage``."""
        readings = list(readings)
        held = self._held(readings)
        counts = self.table.agg(
            self._sum().alias("n_rows"), self._sum(held > 0).alias("n_any"), self._sum(held == len(readings)).alias("n_all"), self._sum(~self.misses(readings[0])).alias("n_first")
        )
        return counts.withColumn("n_gained", F.col("n_any") - F.col("n_first"))

    def missing_corr(self) -> DataFrame:
        """As ``missing.missing_corr``: r from counts of rows that miss either column and both, all whole numbers."""
        total = self.table.agg(self._sum().alias("n_pairs"))
        absent = F.filter(F.array(*(F.when(self.misses(c), F.lit(k)) for k, c in enumerate(self.columns))), lambda k: k.isNotNull())
        # a pattern's pairs are bounded by the columns; a column's pair with itself counts its own
        pairs = F.flatten(F.transform("absent", lambda i: F.transform(F.filter("absent", lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
        both = self.table.select("n", absent.alias("absent")).select("n", F.inline(pairs)).groupBy("i", "j").agg(F.sum("n").alias("m"))
        own = both.filter("i = j")
        p = len(self.columns)
        every = self.table.sparkSession.range(p).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(p))).alias("j")).filter(F.col("j") < p)
        # columns that never miss have no pairs: these tables have a row for each column, or pair of columns
        first, second = own.select("i", F.col("m").alias("a")), own.select("j", F.col("m").alias("b"))
        met = every.join(first, "i").join(second, "j").join(both.filter("i < j"), ["i", "j"], "left").crossJoin(F.broadcast(total))
        n, a, b, m = (F.col(c).cast("double") for c in ("n_pairs", "a", "b", "m"))
        r = F.try_divide(n * F.coalesce(m, F.lit(0.0)) - a * b, F.sqrt(a * (n - a)) * F.sqrt(b * (n - b)))
        name = lambda k: F.element_at(F.lit(self.columns), F.col(k) + 1)
        return met.select(name("i").alias("variable_1"), name("j").alias("variable_2"), "n_pairs", F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)).alias("r")).filter("r is not null")
