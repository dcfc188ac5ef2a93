"""The stages, each a function of DataFrames; nothing runs but what is asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import SURVEY, Catalog
from ..functions import columns as C
from ..operators import correlate, density, groups, missing, outliers, panel, profile, rules, transforms
from ..operators.longform import position, to_long
from ..operators.patterns import Patterns
from ..operators.quality import check_unique, require_columns
from ..sources import tables


def merge(datasets: dict[str, DataFrame], catalog: Catalog = SURVEY, flags: bool = False) -> DataFrame:
    """Stage 1: the master table with all others joined to its left."""
    others = {d.name: datasets[d.name] for d in catalog.datasets[1:]}
    return panel.left_join_chain(datasets[catalog.master.name], others, catalog.key, flags)


def merge_report(datasets: dict[str, DataFrame], catalog: Catalog = SURVEY) -> DataFrame:
    return panel.match_report(merge(datasets, catalog, flags=True), {d.name: list(d.columns) for d in catalog.datasets[1:]})


def decisions(catalog: Catalog = SURVEY):
    """The cleaning rules in order, as (number, label, function); the order matters: ratios come after the null rules."""
    low, high = catalog.age_range
    return [
        ("002", "bp_averaging", lambda df: transforms.average_readings(df, catalog.readings)),
        ("003", "age_filter", lambda df: transforms.range_filter(df, catalog.age_column, low, high)),
        ("004", "dexa_validity", lambda df: transforms.null_unless_valid(df, *catalog.valid_flag)),
        ("005", "insulin_lod", lambda df: transforms.null_if_flagged(df, *catalog.invalid_flag)),
        ("006", "derived_features", lambda df: transforms.derive(df, catalog.derived)),
    ]


def preprocess(merged: DataFrame, catalog: Catalog = SURVEY, snapshots: str | None = None) -> DataFrame:
    """Stage 2: all decisions, one stage of the plan; with ``snapshots``, each step is written to that folder."""
    for number, label, step in decisions(catalog):
        merged = merged.transform(step)
        if snapshots:
            merged = tables.snapshot(merged, snapshots, number, label)
    return merged


#: Points of a drawn curve, and bins of the ages.
CURVE, AGE_BINS = 200, 30


@dataclass
class Profile:
    """Stage 3's results, lazy but for the recommendations."""

    overview: DataFrame
    types: DataFrame
    cells: DataFrame
    missing: DataFrame
    expected: DataFrame
    complete: DataFrame
    co_missing: DataFrame
    distributions: DataFrame
    outliers: DataFrame
    correlations: DataFrame
    high_pairs: DataFrame
    label_counts: dict[str, DataFrame]
    age: DataFrame
    bins: DataFrame
    by_label: dict[str, DataFrame]
    plots: dict[str, DataFrame]  # what the figures draw: bounded by bins, variables and labels
    recommendations: list[rules.Recommendation]
    verdict: str


def small(df: DataFrame) -> DataFrame:
    """A result of a bounded number of rows (the catalogue's variables, pairs or groups), computed once and held as local rows, in order."""
    rows = df.collect()
    return df.sparkSession.createDataFrame(rows, df.schema).coalesce(1)


def profile_panel(df: DataFrame, catalog: Catalog = SURVEY) -> Profile:
    """Stage 3: all phases over one table. Give it cached or written: each phase reads it."""
    t, features = catalog.thresholds, list(catalog.features)
    require_columns(df, [catalog.key, *catalog.demographics, *features], "profile")
    spark = df.sparkSession
    measured = [c for c in df.columns if c != catalog.key]
    long = to_long(df, features)
    in_order = lambda d: d.orderBy(position(features))
    # each is read by the rules, the tables and the summary, and has one row a variable or pair of variables
    shapes = small(in_order(profile.distributions(long, t.heavy_skew, t.moderate_skew, t.min_values)))
    beyond = small(in_order(outliers.outlier_counts(long, catalog.ranges, t.mild_fence, t.extreme_fence, t.min_values)))
    pairs = small(correlate.pearson(df, features, t.min_pairs))
    # one scan for all that is missing
    patterns = Patterns.of(df, measured)
    patterns.table = patterns.table.cache()
    absent = small(patterns.missing_table(t.high_missing_pct))
    first, *_ = catalog.labels
    labelled = df.withColumns({f"{c}_label": C.label_of(F.col(c), labels) for c, labels in catalog.labels.items()})
    labelled = labelled.withColumns({f"{c}_bin": C.bin_of(F.col(c), bins) for c, bins in catalog.bins.items()})
    shown = [c for c in catalog.shown if c in df.columns]
    together = small(patterns.missing_corr())
    sets = small(groups.label_sets(labelled, shown, [f"{first}_label", *(f"{c}_bin" for c in catalog.bins)]))
    by_label = {first: groups.group_means(labelled, shown, f"{first}_label", sorted(catalog.labels[first].values()))}
    by_label |= {c: groups.group_means(labelled, shown, f"{c}_bin", [label for *_, label in bins]) for c, bins in catalog.bins.items()}
    # the rules look at one row a variable
    skewed = [r["variable"] for r in shapes.filter(F.abs("skewness") > t.heavy_skew).collect()]
    investigate = [r["variable"] for r in beyond.filter("n_requires_inv > 0").collect()]
    found = rules.recommendations(skewed, investigate, correlate.redundant(features, catalog.redundant))
    roles = spark.createDataFrame([(k, c, catalog.role(c), kind) for k, (c, kind) in enumerate(df.dtypes)], "position int, variable string, role string, type string")
    age = catalog.age_column
    enough = long.join(F.broadcast(shapes.select("variable")), "variable", "left_semi")  # one row a variable
    with_age = to_long(df, [age])
    plots = {
        "histograms": in_order(density.auto_histogram(enough)),
        "curves": in_order(density.density(enough, grid=CURVE, cut=0.0)),
        "boxes": in_order(profile.box_stats(enough, "value", ["variable"])),
        "flier_bins": in_order(profile.flier_bins(enough, "value", ["variable"])),
        "stretches": missing.missing_by_stretch(df, catalog.key, measured),
        "missing_correlations": together,
        "age_histogram": profile.histogram(df, age, AGE_BINS).orderBy("bin"),
        "age_curve": density.density(with_age, grid=CURVE, cut=0.0),
        "label_sets": sets,
    }
    return Profile(
        overview=roles,
        types=profile.type_frequency(df),
        cells=small(missing.missing_cells(df)),
        missing=absent,
        expected=missing.expected(absent, catalog.expected_missing),
        complete=small(patterns.complete_cases(catalog.feature_sets())),
        co_missing=missing.co_missing(together, t.co_missing),
        distributions=shapes,
        outliers=beyond,
        correlations=pairs,
        high_pairs=correlate.noted(correlate.high_pairs(pairs, t.high_corr, t.very_high_corr), catalog.notes),
        label_counts={c: groups.frequency(labelled, f"{c}_label") for c in catalog.labels},
        age=profile.scalars(df, age),
        bins=groups.label_shares(labelled, f"{age}_bin").orderBy(f"{age}_bin"),
        by_label=by_label,
        plots={name: small(d) for name, d in plots.items()},
        recommendations=found,
        verdict=rules.verdict(found),
    )


def land(spark: SparkSession, folder: str, out: str, catalog: Catalog = SURVEY, buckets: int = 64, prefix: str = "loomstat") -> dict[str, DataFrame]:
    """All datasets as tables in buckets of the key below ``out``/landed, checked for unique keys there: neither that nor the merge shuffles them again.

    The key becomes a whole number (one that is not fails the job): of floats, Spark would take the hash anew, past the buckets.
    """
    whole = F.when(F.col(catalog.key) == F.floor(catalog.key), F.col(catalog.key).cast("long")).when(F.col(catalog.key).isNotNull(), F.raise_error(F.lit(f"{catalog.key} is not a whole number")).cast("long"))
    read = {name: df.withColumn(catalog.key, whole) for name, df in tables.read_datasets(spark, folder, catalog, validate=False).items()}
    landed = {name: tables.write_bucketed(df, f"{prefix}_{name}", f"{out}/landed/{name}", catalog.key, buckets) for name, df in read.items()}
    check_unique(landed, catalog.key)
    return landed


def run_merge(spark: SparkSession, folder: str, out: str, catalog: Catalog = SURVEY, buckets: int | None = None) -> DataFrame:
    """Stage 1 from CSV files to ``out``/merged, by way of tables in ``buckets`` if given; what matched is counted as it is written."""
    datasets = land(spark, folder, out, catalog, buckets) if buckets else tables.read_datasets(spark, folder, catalog)
    others = {d.name: list(d.columns) for d in catalog.datasets[1:]}
    merged, seen = panel.observed_matches(merge(datasets, catalog, flags=True), others)
    merged = merged.withColumn(catalog.key, F.col(catalog.key).cast("double"))
    written = tables.write_table(merged, f"{out}/merged")
    tables.write_small(spark.createDataFrame(panel.told_matches(seen.get, others), panel.MATCH_REPORT), f"{out}/reports/matches")
    return written


def run_preprocess(spark: SparkSession, out: str, catalog: Catalog = SURVEY, snapshots: bool = False) -> DataFrame:
    """Stage 2 from ``out``/merged to ``out``/preprocessed; what each decision changed is counted as it is written."""
    merged = tables.read_table(spark, f"{out}/merged")
    if snapshots:
        return tables.write_table(preprocess(merged, catalog, f"{out}/snapshots"), f"{out}/preprocessed")
    steps = decisions(catalog)
    watched = [*catalog.valid_flag[2], *catalog.invalid_flag[2], *catalog.readings, *(d.name for d in catalog.derived)]
    cleaned, points = transforms.observed(merged, steps, watched)
    written = tables.write_table(cleaned, f"{out}/preprocessed")
    tables.write_small(spark.createDataFrame(transforms.told_changes(steps, points, watched), transforms.CHANGES), f"{out}/reports/changes")
    return written


def run_profile(spark: SparkSession, out: str, catalog: Catalog = SURVEY) -> Profile:
    """Stage 3 from ``out``/preprocessed to tables, reports and figures below ``out``/profile."""
    from .figures import write_figures
    from .report import write_reports

    found = profile_panel(tables.read_table(spark, f"{out}/preprocessed"), catalog)
    write_reports(spark, found, f"{out}/profile", catalog)
    write_figures(spark, found, f"{out}/profile", catalog)
    return found
