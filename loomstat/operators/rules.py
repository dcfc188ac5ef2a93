"""recommendations as structured rows, from the profile's results."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Recommendation:
    """``applies`` tells whether it counts; ``decision`` is the decision it asks for."""

    source: str
    decision: str
    applies: bool
    text: str


def recommendations(heavily_skewed: list[str], investigate: list[str], redundant: list[tuple[str, str]]) -> list[Recommendation]:
    """One for each of distributions, outliers and correlations, in that order."""
    pairs = ", ".join(f"{a} + {b}" for a, b in redundant)
    return [
        Recommendation("distributions", "007", bool(heavily_skewed), f"Log-transform {len(heavily_skewed)} heavily skewed variables before clustering: {', '.join(heavily_skewed)}." if heavily_skewed else "Distributions need no further preprocessing."),
        Recommendation("outliers", "007", bool(investigate), f"Decide on outliers of {', '.join(investigate)} one by one after review." if investigate else "All extreme values are plausible."),
        Recommendation("correlations", "008", bool(redundant), f"Decide whether to keep both raw and derived variables: {pairs}." if redundant else "No structural redundancy."),
    ]


def applied(shapes: DataFrame, beyond: DataFrame, pairs: DataFrame, known: Iterable[tuple[str, str]], heavy: float = 2.0) -> DataFrame:
    """F21 as a table (source, decision, n_found, applies): which recommendations count, from the profile's results, without collecting them.

    Heavily skewed variables, variables with values to investigate, and known (raw, derived) pairs of which both hold values together.
    """
    related = F.array_sort(F.array("variable_1", "variable_2")).isin([F.array(*map(F.lit, sorted(pair))) for pair in known]) if known else F.lit(False)
    found = [
        ("distributions", "007", shapes.agg(F.count_if(F.abs("skewness") > heavy).alias("n_found"))),
        ("outliers", "007", beyond.agg(F.count_if(F.col("n_requires_inv") > 0).alias("n_found"))),
        ("correlations", "008", pairs.agg(F.count_if(related & (F.col("n_pairs") > 0)).alias("n_found"))),
    ]
    first, *others = (d.select(F.lit(source).alias("source"), F.lit(decision).alias("decision"), "n_found", (F.col("n_found") > 0).alias("applies")) for source, decision, d in found)
    for other in others:
        first = first.unionByName(other)
    return first


# The two verdicts of the profile's summary.
NOT_READY, READY = "Additional preprocessing recommended before clustering.", "Dataset ready for scaling and clustering."


def verdict(found: list[Recommendation]) -> str:
    return NOT_READY if any(r.applies for r in found) else READY
