"""Quality rules: statistics of documents, and decision lists learned from labelled ones.

DataFrame functions only. Each document's statistics come from its own row: words by one split,
repeated 8-word windows by hashing each window and sorting the hashes with their positions
where any repeats. Nothing is shuffled but the labelled statistics.

The decision list is learned by sequential covering: on two thirds of the labelled rows a rule
grows by the threshold condition with the best gain for the rejected class, on the remaining
third it is pruned back to the prefix with the best accuracy there; rows it covers go, and the
next rule is sought, until a pruned rule is no longer right often enough. The rules are emitted
as one ordered Spark CASE expression: the first rule that holds rejects a document.

Edge cases: a null, empty or blank text has no words and statistics of zero, and fails the base
rule; labels that are null, or of documents that are not there, teach nothing; with no labels
of either class the list is empty and only the base rule rejects; repeated rows are judged
each; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, checkpointed, let, table

#: Words in a window.
WINDOW = 8
#: Base rule: fewer words fail; so does a larger share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 0.30
#: Labelled rows at most from which rules are learned, drawn by a hash of doc_id.
SAMPLE = 20_000
#: Thresholds tried for each statistic: so many quantiles of the rows.
CUTS = 64
#: A rule has at most so many conditions, covers at least so many rows of those it grew on, and must be right this often.
MOST_CONDITIONS, LEAST_COVER, LEAST_PRECISION = 3, 8, 0.95
MOST_RULES = 16

#: The statistics on which rules set thresholds: a count over a count, or over a power of it.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "distinct_growth": ("n_distinct", "n_words", 0.88),  # distinct words grow by about this power
    "chars_per_word": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "exclaimed_share": ("n_exclaimed", "n_words"),
    "stopped_share": ("n_stopped", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def _repeated(words: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that occur twice or more."""

    def covered(hashes: Column) -> Column:
        def spread(placed: Column) -> Column:
            same = lambda i, j: F.get(placed, i)["hash"].eqNullSafe(F.get(placed, j)["hash"])
            kept = F.filter(placed, lambda p, i: same(i, i + 1) | same(i, i - 1))
            return let(F.array_sort(F.transform(kept, lambda p: p["at"])), summed)

        def summed(starts: Column) -> Column:
            # each window adds its words up to where the next begins
            own = F.transform(starts, lambda s, i: F.least(F.coalesce(F.get(starts, i + 1) - s, F.lit(width)), F.lit(width)))
            return F.aggregate(own, F.lit(0).cast("long"), lambda total, n: total + n)

        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(placed, spread)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) > width, let(windows, covered)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the counts of each row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    # trimmed of white space, so that only an empty text splits into an empty word
    plain = docs.select("doc_id", F.btrim(text, F.lit(" \t\n\v\f\r")).alias("text"), F.filter(F.split(text, "\n"), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    split = plain.select("*", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", GAP)).alias("words"))
    chars = F.aggregate("words", F.lit(0).cast("long"), lambda total, w: total + F.length(w))
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        chars.alias("word_chars"),
        _count(F.col("text"), "[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words"), window).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _count(F.col("text"), "[A-Z]").alias("n_upper"),
        _count(F.col("text"), "[0-9]").alias("n_digits"),
        _count(F.col("text"), "!").alias("n_exclaimed"),
        _count(F.col("text"), "[.,;:?]").alias("n_stopped"),
    )


def ratio(name: str) -> Column:
    over, under, *power = RATIOS[name]
    return F.when(F.col(under) > 0, F.col(over) / (F.pow(under, F.lit(power[0])) if power else F.col(under))).otherwise(0.0)


@dataclass(frozen=True)
class Condition:
    """``name >= value`` if ``above``, else ``name <= value``."""

    name: str
    above: bool
    value: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Which rows of ``values`` (a column for each of RATIOS) it holds for."""
        own = values[:, list(RATIOS).index(self.name)]
        return own >= self.value if self.above else own <= self.value

    def column(self) -> Column:
        return ratio(self.name) >= self.value if self.above else ratio(self.name) <= self.value

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.value:.4g}"


Rule = list[Condition]


def _covered(rule: Rule, values: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.holds(values) for c in rule])


def _candidates(values: np.ndarray) -> list[Condition]:
    found = []
    for name, column in zip(RATIOS, np.sort(values, axis=0).T):
        for value in np.unique(column[(len(column) - 1) * np.arange(CUTS + 1) // CUTS]).tolist():
            found += [Condition(name, True, value), Condition(name, False, value)]
    return found


def _grown(values: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition with the best information gain (bad rows kept times the rise in log precision) while it has any."""
    rule: Rule = []
    while len(rule) < MOST_CONDITIONS and 0 < bad.sum() < len(bad):
        best, gain = None, 0.0
        for c in _candidates(values[bad]):
            kept = c.holds(values)
            n, n_bad = int(kept.sum()), int((kept & bad).sum())
            if n >= LEAST_COVER and n_bad:
                new = n_bad * math.log2(n_bad / n / bad.mean())
                if new > gain:
                    best, gain = c, new
        if best is None:
            break
        rule.append(best)
        kept = best.holds(values)
        values, bad = values[kept], bad[kept]
    return rule


def _pruned(rule: Rule, values: np.ndarray, bad: np.ndarray) -> Rule:
    """The prefix of the rule with the best share of bad rows among those it covers of ``values``, which it did not grow on; the shortest of the best."""

    def worth(n: int) -> float:
        kept = _covered(rule[:n], values)
        return float(bad[kept].mean()) if kept.any() else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))]


def learned(values: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """An ordered list of rules that reject, from the statistics of labelled rows."""
    fold = np.arange(len(bad)) % 3 == 0
    grow, prune = (values[~fold], bad[~fold]), (values[fold], bad[fold])
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and grow[1].any() and (rule := _grown(*grow)):
        rule = _pruned(rule, *prune)
        judge = prune if _covered(rule, prune[0]).any() else grow
        if judge[1][_covered(rule, judge[0])].mean() < LEAST_PRECISION:
            break
        rules.append(rule)
        grow, prune = ((v[~(gone := _covered(rule, v))], b[~gone]) for v, b in (grow, prune))
    return rules


def fitted(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from the labelled rows of ``stats``; at most ``sample`` of them, the first by a hash of doc_id."""
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = (
        stats.select("doc_id", *(ratio(n).alias(n) for n in RATIOS))
        .join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
        .collect()
    )
    values = np.array([[r[n] for n in RATIOS] for r in rows], float).reshape(-1, len(RATIOS))
    return learned(values, np.array([r["quality"] == 0 for r in rows], bool))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * round(100 * MOST_REPEATED))


def verdict(rules: list[Rule]) -> Column:
    """1 + the number of the first rule that holds, or 0: one ordered conditional expression."""
    found = F
    for n, rule in enumerate(rules, 1):
        every = F.lit(True)
        for c in rule:
            every &= c.column()
        found = found.when(every, n)
    return found.otherwise(0) if rules else F.lit(0)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of ``docs``, base_failed, rule (the first that rejects, or 0) and kept."""
    stats = checkpointed(statistics(docs))
    rules = fitted(stats, labels)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on all documents, with rules learned from ``labels``."""
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
