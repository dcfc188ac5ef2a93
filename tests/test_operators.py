"""Operators on small frames with expectations computed by hand or by pandas."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.catalog import SURVEY, Catalog, Dataset, Derived
from loomstat.functions import columns as C
from loomstat.operators import correlate, groups, missing, outliers, panel, profile, quality, rules, transforms
from loomstat.operators.longform import to_long

NONE = None


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_left_join_chain_and_report(spark):
    master = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, m double")
    a = spark.createDataFrame([(1, 10.0), (2, None), (9, 90.0)], "k int, a double")
    b = spark.createDataFrame([(1, 5.0, 6.0)], "k int, b1 double, b2 double")
    joined = panel.left_join_chain(master, {"a": a, "b": b}, "k", flags=True)
    assert joined.count() == 3 and {r["k"] for r in joined.collect()} == {1, 2, 3}
    report = {r["dataset"]: r for r in panel.match_report(joined, {"a": ["a"], "b": ["b1", "b2"]}).collect()}
    assert (report["a"]["n_matched"], report["a"]["n_unmatched"], report["a"]["n_last_col_present"]) == (2, 1, 1)
    assert report["b"]["n_added_nulls"] == 4


def test_key_checks(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (3,)], "k int")
    assert sorted(rows(quality.duplicate_keys(df, "k"))) == [(2, 2, 1), (3, 3, 2)]
    assert rows(quality.key_report(df, "k")) == [(6, 3, 2, 3, 0)]
    with pytest.raises(quality.DuplicateKeyError, match="2 x2"):
        quality.check_unique({"t": df}, "k")
    with pytest.raises(quality.DuplicateKeyError):
        quality.check_unique({"t": spark.createDataFrame([(None,)], "k int")}, "k")
    quality.check_unique({"t": df.distinct()}, "k")
    assert rows(quality.key_report(df.limit(0), "k")) == [(0, 0, 0, 0, 0)]


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(quality.MissingColumnsError, match=r"missing \['b'\]; available \['a'\]"):
        quality.require_columns(df, ["a", "b"], "step")


def test_row_mean_skips_nulls_not_zeros(spark):
    df = spark.createDataFrame([(120.0, 130.0, 140.0), (NONE, 110.0, 120.0), (NONE, NONE, 100.0), (NONE, NONE, NONE), (0.0, NONE, 10.0)], "a double, b double, c double")
    assert rows(transforms.average_readings(df, {"m": ("a", "b", "c")}).select("m")) == [(130.0,), (115.0,), (100.0,), (NONE,), (5.0,)]
    assert rows(missing.readings_histogram(df, ["a", "b", "c"])) == [(0, 1), (1, 1), (2, 2), (3, 1)]
    assert rows(missing.coverage(df, ["a", "b", "c"])) == [(5, 4, 1, 2, 2)]


def test_range_and_bins(spark):
    ages = spark.createDataFrame([(x,) for x in (19.0, 20.0, 39.0, 39.5, 40.0, 59.0, 60.0, 80.0, 81.0, NONE)], "age double")
    assert transforms.range_filter(ages, "age", 20, 80).count() == 7
    binned = ages.withColumn("bin", C.bin_of(F.col("age"), SURVEY.bins["RIDAGEYR"]))
    assert [r["bin"] for r in binned.collect()] == [NONE, "20-39", "20-39", "40-59", "40-59", "40-59", "60-80", "60-80", NONE, NONE]
    shares = {r["bin"]: (r["n"], r["pct"]) for r in groups.label_shares(binned, "bin").collect()}
    assert shares == {"20-39": (2, 20.0), "40-59": (3, 30.0), "60-80": (2, 20.0)}


def test_null_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (NONE, 5.0)], "flag int, v double")
    assert [r["v"] for r in transforms.null_unless_valid(df, "flag", 1, ["v"]).collect()] == [5.0, NONE, NONE]
    assert [r["v"] for r in transforms.null_if_flagged(df, "flag", 1, ["v"]).collect()] == [NONE, 5.0, 5.0]
    assert rows(transforms.null_changes(df, {"v": C.null_unless(F.col("flag"), 1, F.col("v"))})) == [("v", 0, 2, 2)]


def test_derived_columns_propagate_nulls(spark):
    df = spark.createDataFrame([(90.0, 9.0, 200.0, 50.0, 150.0), (NONE, 9.0, 200.0, NONE, 150.0), (90.0, 9.0, 200.0, 0.0, 150.0)], "LBXGLU double, LBXIN double, LBXTC double, LBDHDD double, LBXSTR double")
    found = rows(transforms.derive(df, SURVEY.derived).select("HOMA_IR", "TC_HDL_ratio", "TG_HDL_ratio"))
    assert found == [(2.0, 4.0, 3.0), (NONE, NONE, NONE), (2.0, NONE, NONE)]


def long_of(spark, **columns):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, vs in columns.items() for v in vs], "variable string, value double")


def test_moments(spark):
    long = long_of(spark, a=[1, 2, 4, 9, NONE], constant=[3.0] * 10, two=[1, 2])
    shape = {r["variable"]: r for r in profile.shape(long).collect()}
    assert shape["a"]["n_valid"] == 4
    assert shape["a"]["skewness"] == pytest.approx(1.33094, abs=1e-5) and shape["a"]["kurtosis"] == pytest.approx(1.5)
    assert shape["constant"]["skewness"] == 0.0 == shape["constant"]["kurtosis"]
    assert shape["two"]["skewness"] is None
    found = {r["variable"]: r for r in profile.describe(long).collect()}
    assert (found["a"]["p25"], found["a"]["median"], found["a"]["p75"]) == (1.75, 3.0, 5.25)
    assert found["a"]["std"] == pytest.approx(pd.Series([1, 2, 4, 9.0]).std())


def test_sample_gate_and_rounding(spark):
    long = long_of(spark, nine=range(9), ten=range(10))
    assert [r["variable"] for r in profile.distributions(long).collect()] == ["ten"]


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 30011])
def test_radix_quantiles_are_exact(spark, n):
    values = spark.range(n).select(F.lit("x").alias("variable"), ((F.col("id") * 7919) % 1009 + F.rand(3)).alias("value")).union(spark.createDataFrame([("x", None)], "variable string, value double"))
    values = values.union(spark.range(40).select(F.lit("y"), F.lit(2.5))).cache()
    for by in (["variable"], []):
        exact = sorted(rows(profile.quantiles(values, (0.0, 0.25, 0.5, 0.9, 1.0), by)))
        large = sorted(rows(profile.quantiles(values, (0.0, 0.25, 0.5, 0.9, 1.0), by, in_memory=0)))
        for a, b in zip(exact, large, strict=True):
            assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], rel=1e-12)


def test_histogram_and_box(spark):
    df = spark.createDataFrame([("g", float(x)) for x in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]], "g string, v double")
    bins = profile.histogram(df, "v", 10).orderBy("bin").collect()
    assert len(bins) == 10 and bins[0]["n"] == 9 and bins[-1]["n"] == 1 and sum(b["n"] for b in bins) == 10
    box = profile.box_stats(df, "v", ["g"]).first()
    assert (box["whisker_low"], box["whisker_high"], box["n_fliers"]) == (1.0, 9.0, 1)
    assert profile.box_stats(df, "v").first()["median"] == 5.5
    constant = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert sum(b["n"] for b in profile.histogram(constant, "v", 4).collect()) == 2
    assert profile.histogram(constant.limit(0), "v", 4).count() == 0


def test_fences_are_strict_and_classes_inclusive(spark):
    base = [10.0] * 3 + [20.0] * 3 + [30.0] * 3  # q1 10, q3 30
    long = long_of(spark, v=[*base, 60.0, -20.0])
    lines = outliers.fences(long).first()
    on_fence = lines["q3"] + 1.5 * lines["iqr"]
    assert on_fence == lines["upper_mild"]
    values = spark.createDataFrame([(x,) for x in (5.0, 10.0, 20.0, 2.4, 2.5, 40.0, 40.1)], "x double")
    kinds = [r[0][0] for r in values.select(C.plausibility(F.col("x"), F.lit(5.0), F.lit(20.0))).collect()]
    assert kinds == ["B", "B", "B", "R", "S", "S", "R"]
    assert values.select(C.plausibility(F.col("x"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("k")).distinct().count() == 1
    counts = outliers.outlier_counts(long_of(spark, v=[*range(20), 1000.0]), {"v": (0, 100)}).first()
    assert (counts["n_mild_outliers"], counts["n_extreme_outliers"], counts["n_requires_inv"], counts["pct_mild"]) == (1, 1, 1, 4.76)


def pairs_of(df):
    return {(r["variable_1"], r["variable_2"]): r for r in df.collect()}


def test_pearson_is_pairwise_complete(spark):
    data = pd.DataFrame({"a": [float((7 * k) % 31) for k in range(60)], "c": [5.0] * 60})
    data["b"] = data["a"] * 2 + [float(k % 5) for k in range(60)]
    data.loc[::2, "b"] = None  # 30 complete pairs
    data["d"] = data["b"]
    data.loc[1, "d"] = None  # 29
    df = spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in data[["a", "b", "c", "d"]].itertuples(index=False)], "a double, b double, c double, d double")
    found = pairs_of(correlate.pearson(df, ["a", "b", "c", "d"]))
    assert len(found) == 6
    assert found["a", "b"]["n_pairs"] == 30 and found["a", "b"]["r"] == pytest.approx(data["a"].corr(data["b"]))
    assert found["a", "c"]["r"] is None and found["a", "d"]["n_pairs"] == 29 and found["a", "d"]["r"] is None
    high = correlate.high_pairs(correlate.pearson(df, ["a", "b", "c", "d"])).collect()
    assert [(r["variable_1"], r["variable_2"], r["level"]) for r in high] == [("a", "b", "VERY HIGH")]
    square = correlate.matrix(correlate.pearson(df, ["a", "b"]), ["a", "b"]).collect()
    assert square[0]["a"] == 1.0 and square[0]["b"] == square[1]["a"]


def test_missing_tables(spark):
    df = spark.createDataFrame([(1, NONE, NONE, 1.0), (2, NONE, NONE, NONE), (3, 1.0, 1.0, NONE), (4, 1.0, 1.0, 1.0)], "k int, a double, b double, c double")
    table = missing.missing_table(df, ["k", "a", "b", "c"]).collect()
    assert [(r["variable"], r["missing_count"], r["missing_pct"], r["is_high"]) for r in table] == [("a", 2, 50.0, True), ("b", 2, 50.0, True), ("c", 2, 50.0, True), ("k", 0, 0.0, False)]
    assert rows(missing.missing_cells(df)) == [(4, 4, 16, 6, 37.5)]
    assert rows(missing.complete_cases(df, {"all": ["k", "a", "b", "c"], "ab": ["a", "b"]})) == [("all", 4, 1, 4), ("ab", 2, 2, 4)]
    pairs = missing.missing_corr(df.withColumn("e", F.when(F.col("a").isNull(), 1)), ["k", "a", "b", "e"])
    assert {k: v["r"] for k, v in pairs_of(pairs).items()} == {("a", "b"): pytest.approx(1.0), ("a", "e"): pytest.approx(-1.0), ("b", "e"): pytest.approx(-1.0)}
    assert missing.co_missing(pairs).count() == 3
    assert rows(missing.missing_matrix(df, ["a"])) == [(1,), (1,), (0,), (0,)]
    assert {r["variable"]: r["expected"] for r in missing.expected(missing.missing_table(df, ["a", "b"]), ["a"]).collect()} == {"a": True, "b": False}


def test_labels_and_groups(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 30.0), (5, 1.0), (NONE, 2.0)], "code int, v double")
    df = df.withColumn("label", C.label_of(F.col("code"), {1: "Male", 2: "Female"}))
    assert rows(groups.frequency(df, "label")) == [("Male", 2), ("Female", 1)]
    assert rows(groups.code_frequency(df, "code")) == [(1, 2), (2, 1), (5, 1), (NONE, 1)]
    means = groups.group_means(df, ["v"], "label", ["Female", "Male"])
    assert rows(means) == [("v", 30.0, 15.0)]
    assert rows(groups.group_diff_pct(means, "Male", "Female").select("diff_pct")) == [(-50.0,)]
    zero = spark.createDataFrame([("v", 0.0, 1.0)], "variable string, Female double, Male double")
    assert rows(groups.group_diff_pct(zero, "Male", "Female").select("diff_pct")) == [(NONE,)]


def test_skew_classes(spark):
    df = spark.createDataFrame([(x,) for x in (2.0, 2.1, -2.1, 1.0, 1.5, -1.5, 0.0)], "s double")
    assert [r[0] for r in df.select(C.skew_class(F.col("s"))).collect()] == [
        "Moderately skewed (right)", "HEAVILY SKEWED (right)", "HEAVILY SKEWED (left)", "Approximately symmetric",
        "Moderately skewed (right)", "Moderately skewed (left)", "Approximately symmetric",
    ]


def test_rules():
    found = rules.recommendations(["x"], [], [("a", "b")])
    assert [r.applies for r in found] == [True, False, True] and "recommended" in rules.verdict(found)
    assert rules.verdict(rules.recommendations([], [], [])) == "Dataset ready for scaling and clustering."


def test_catalog_checks():
    assert sum(len(d.columns) for d in SURVEY.datasets) + 1 == 34 and len(SURVEY.features) == 27
    assert {k: len(v) for k, v in SURVEY.feature_sets().items()} == {"all": 27, "core": 21, "no_dexa": 24, "no_fasting": 24}
    fields = {f: getattr(SURVEY, f) for f in SURVEY.__dataclass_fields__}
    with pytest.raises(ValueError, match="no dataset or rule makes"):
        Catalog(**fields | {"derived": (Derived("x", "y", ("nowhere",)),)})
    with pytest.raises(ValueError, match="master"):
        Catalog(**fields | {"datasets": (Dataset("a", "a.csv", ("x",)),)})


def test_rows_of_nulls_change_no_moment(spark):
    df = spark.createDataFrame([(float(k * k % 17),) for k in range(40)], "v double")
    with_nulls = df.union(spark.createDataFrame([(None,)] * 5, "v double")).repartition(7)
    a, b = (profile.distributions(to_long(d, ["v"])).first().asDict() for d in (df, with_nulls))
    assert all(x == y or math.isclose(x, y) for x, y in zip(a.values(), b.values()) if not isinstance(x, str))
