"""Assembly of a wide panel: a chain of left joins on one key, and its diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

MATCHED = "_matched_"


def left_join_chain(master: DataFrame, others: dict[str, DataFrame], key: str, flags: bool = False) -> DataFrame:
    """``master`` with each table of ``others`` joined to its left on ``key``.

    Broadcasting is left to the optimizer, which knows the sizes. The keys hash alike in each
    join, so that shuffled joins of the chain reuse one partitioning of the left side. With
    ``flags``, a column ``_matched_<name>`` tells which tables had the key.
    """
    panel = master
    for name, right in others.items():
        right = right.withColumn(MATCHED + name, F.lit(True)) if flags else right
        panel = panel.join(right, key, "left")
    return panel


def match_report(panel: DataFrame, others: dict[str, list[str]]) -> DataFrame:
    """For each joined table, matched and unmatched rows, and nulls added by rows without a match.

    ``panel`` has the flags of ``left_join_chain``; ``others`` gives each table's columns. One
    pass over the panel for all tables. ``n_last_col_present`` counts values in the last column.
    """
    parts = []
    for name, columns in others.items():
        hit = F.coalesce(F.col(MATCHED + name), F.lit(False))
        parts.append(
            F.struct(
                F.lit(name).alias("dataset"),
                F.count_if(hit).alias("n_matched"),
                F.count_if(~hit).alias("n_unmatched"),
                (F.count_if(~hit) * len(columns)).alias("n_added_nulls"),
                F.count(columns[-1]).alias("n_last_col_present"),
            )
        )
    return panel.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))


def observed_matches(panel: DataFrame, others: dict[str, list[str]]) -> tuple[DataFrame, Observation]:
    """J03 in passing: ``panel`` without the flags of ``left_join_chain``, and the counts that whatever writes it gathers.

    The joins lie below, so the counts belong to the stage that writes: a task that is tried again counts once.
    """
    seen = Observation("matches")
    counts = [F.count(F.lit(1)).alias("rows")]
    for name, columns in others.items():
        counts += [F.count(MATCHED + name).alias(f"matched {name}"), F.count(columns[-1]).alias(f"present {name}")]
    return panel.observe(seen, *counts).drop(*(MATCHED + name for name in others)), seen


def told_matches(counts: dict[str, int], others: dict[str, list[str]]) -> list[tuple[str, int, int, int, int]]:
    """The rows of ``match_report`` from observed counts."""
    rows = []
    for name, columns in others.items():
        lacking = counts["rows"] - counts[f"matched {name}"]
        rows.append((name, counts[f"matched {name}"], lacking, lacking * len(columns), counts[f"present {name}"]))
    return rows


MATCH_REPORT = "dataset string, n_matched long, n_unmatched long, n_added_nulls long, n_last_col_present long"
