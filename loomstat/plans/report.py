"""Reports: tables as CSV, a text for each phase and a summary in Markdown, from small collected results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog
from ..operators import correlate
from ..sources.tables import write_small, write_text


def _cell(value) -> str:
    if value is None:
        return "-"
    return f"{value:,.4f}".rstrip("0").rstrip(".") if isinstance(value, float) else f"{value:,}" if isinstance(value, int) else str(value)


def text_table(df: DataFrame) -> str:
    """An aligned table of a small result."""
    rows = [df.columns, *([_cell(v) for v in r] for r in df.collect())]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows)


def markdown_table(df: DataFrame) -> str:
    rows = [[_cell(v) for v in r] for r in df.collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def phases(found, catalog: Catalog) -> dict[str, dict[str, DataFrame]]:
    """Each phase's tables, by name."""
    return {
        "overview": {"variables": found.overview, "types": found.types, "cells": found.cells},
        "missingness": {"missing_values": found.missing, "high_missing": found.expected, "complete_cases": found.complete, "co_missing": found.co_missing},
        "distributions": {"distributions": found.distributions},
        "outliers": {"outlier_counts": found.outliers},
        "correlations": {"correlation_matrix": correlate.matrix(found.correlations, catalog.features), "high_correlations": found.high_pairs},
        "demographics": {"age": found.age, "age_groups": found.bins, **{f"counts_{c}": d for c, d in found.label_counts.items()}, **{f"means_{c}": d for c, d in found.by_label.items()}},
    }


def summary(found, catalog: Catalog) -> str:
    """The Markdown summary: all phases in short, the recommendations and the verdict."""
    lines = ["# Profile", "", f"**{found.verdict}**"]
    shown = {
        "Overview": [found.cells],
        "Missing values": [found.complete, found.expected],
        "Distributions": [found.distributions.filter("abs(skewness) > 1.0").select("variable", "skewness", "skew_class")],
        "Outliers": [found.outliers.filter("n_requires_inv > 0").select("variable", "max_value", "n_extreme_outliers", "n_requires_inv")],
        "Correlations": [found.high_pairs],
        "Groups": [found.age, found.bins, *found.label_counts.values()],
    }
    for title, parts in shown.items():
        lines += ["", f"## {title}"]
        for part in parts:
            lines += ["", markdown_table(part)]
    lines += ["", "## Recommendations", ""]
    lines += [f"- {r.source}: {r.text} (decision {r.decision}{'' if r.applies else '; does not apply'})" for r in found.recommendations]
    return "\n".join(lines) + "\n"


def write_reports(spark: SparkSession, found, folder: str, catalog: Catalog) -> None:
    """All tables, texts and the summary below ``folder``."""
    for phase, parts in phases(found, catalog).items():
        text = []
        for name, df in parts.items():
            df = df.cache()
            write_small(df, f"{folder}/{phase}/{name}")
            text += [name, text_table(df), ""]
            df.unpersist()
        write_text(spark, f"{folder}/{phase}/report.txt", "\n".join(text))
    write_text(spark, f"{folder}/SUMMARY.md", summary(found, catalog))
