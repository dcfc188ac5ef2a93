"""Co-moments, radix quantiles, density curves, automatic bins, fliers, label sets and patterns of missingness."""

import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.functions.ordering import from_bits, with_bits
from loomstat.operators import correlate, density, groups, missing, profile
from loomstat.operators.comoments import Block
from loomstat.operators.longform import to_long, with_rows
from loomstat.operators.patterns import Patterns

NAN, INF = float("nan"), float("inf")


def frame(spark, data: dict):
    rows = list(zip(*data.values()))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)


def pairs_of(df):
    return {(r["variable_1"], r["variable_2"]): (r["n_pairs"], r["r"]) for r in df.collect()}


def odd_columns(rng, n=200, p=9) -> dict:
    data = {f"v{k}": rng.normal(k, 1 + k, n).tolist() for k in range(p)}
    data["v0"][3] = NAN
    data["v1"][5] = None
    data["v2"] = [1e9 + x for x in data["v2"]]
    data["v3"] = [0.1 + 0.2] * n  # constant, not exact in binary
    data["v4"] = [7.3 if data["v5"][k] is not None and k < 50 else x for k, x in enumerate(data["v4"])]
    data["v5"] = [x if k < 50 else None for k, x in enumerate(data["v5"])]  # v4 is constant where v5 is there
    data["v6"][9] = INF
    data["v7"] = [3 * x + 1 if x is not None else None for x in data["v1"]]
    return data


def test_one_result_for_any_number_of_columns(spark):
    data = odd_columns(np.random.default_rng(1))
    df = frame(spark, data)
    names = list(data)
    nine = pairs_of(correlate.pearson(df, names))
    eight = pairs_of(correlate.pearson(df, names[:8]))
    two = pairs_of(correlate.pearson(df, ["v0", "v1"]))
    assert {k for k in nine if "v8" not in k} == eight.keys()
    for k, (n, r) in (eight | two).items():  # but for rounding: v2 is 1e9 times as large as it varies
        assert nine[k] == (n, r if r is None else pytest.approx(r, abs=1e-7)), k
    table = pd.DataFrame(data, dtype=float)
    for (a, b), (n, r) in nine.items():
        both = table[[a, b]].dropna()
        assert n == len(both)
        if "v3" in (a, b) or "v6" in (a, b) or (a, b) == ("v4", "v5"):
            assert r is None, (a, b)
        else:
            assert r == pytest.approx(both[a].corr(both[b]), abs=1e-7)
    assert nine["v1", "v7"][1] == pytest.approx(1.0) and nine["v1", "v7"][1] <= 1.0
    assert pairs_of(correlate.pearson(df.limit(0), ["v0", "v1"])) == {("v0", "v1"): (0, None)}


def test_blocks_merge_in_any_grouping():
    rng = np.random.default_rng(2)
    x = rng.normal(1e6, 1, (500, 4))
    x[rng.random(x.shape) < 0.2] = NAN
    x[:, 3] = 5.0
    whole = Block.of(x)
    for cuts in ([1, 2, 3], [100, 400], [250]):
        total = Block(4)
        for part in np.split(x, cuts):
            total.add(Block.of(part))
        np.testing.assert_allclose(total.correlations()[0], whole.correlations()[0])
        np.testing.assert_allclose(total.correlations()[1], whole.correlations()[1], rtol=1e-8)
        assert np.isnan(total.correlations()[1][3]).all()


def test_bits_keep_order_and_come_back(spark):
    random.seed(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, INF, -INF, 0.1, None, NAN]
    values += [struct.unpack("<d", struct.pack("<Q", random.getrandbits(64)))[0] for _ in range(3000)]
    values += [f(2.0**k) for k in range(-1074, 1024, 7) for f in (float, lambda x: math.nextafter(x, 0), lambda x: math.nextafter(x, INF))]
    df = spark.createDataFrame([(x,) for x in values], "value double")
    for r in with_bits(df, "value", "bits").select("value", "bits", from_bits(F.col("bits")).alias("back")).collect():
        if r["value"] is None or math.isnan(r["value"]):
            assert r["bits"] is None
        else:
            (wanted,) = struct.unpack("<q", struct.pack("<d", abs(r["value"])))
            assert r["bits"] == (-wanted if r["value"] < 0 else wanted) and r["back"] == r["value"]


def plain_quantile(values, p):
    place = p * (len(values) - 1)
    a, b = values[math.floor(place)], values[math.ceil(place)]
    if a == b:
        return a
    found = (1 - place % 1) * a + place % 1 * b
    return None if math.isnan(found) else found


def test_radix_quantiles_of_awkward_groups(spark):
    random.seed(4)
    by_group = {
        "one": [3.5], "heavy": [7.0] * 5000 + [1.0, 9.0], "ends": [-INF, 1.0, 2.0, 3.0, INF], "opposite": [-INF, INF], "zeros": [0.0, -0.0, 0.0],
        "close": [1.0 + k * 2**-52 for k in range(100)], "wide": [random.uniform(-1, 1) * 10.0 ** random.randint(-300, 300) for _ in range(400)], None: [1.0, 2.0, 4.0],
    }
    rows = [(g, v) for g, vs in by_group.items() for v in vs] + [("none", None), ("none", NAN), ("one", NAN), ("one", None)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, value double").repartition(4)
    wanted = {g: [plain_quantile(sorted(vs), p) for p in (0.0, 0.25, 0.5, 0.99, 1.0)] for g, vs in by_group.items()}
    for in_memory in (0, 1 << 60):
        found = {r["g"]: r["q"] for r in profile.quantiles(df, (0.0, 0.25, 0.5, 0.99, 1.0), ["g"], in_memory=in_memory).collect()}
        assert found.keys() == wanted.keys()
        for g in wanted:
            assert all(a == b or math.isclose(a, b, rel_tol=1e-15) for a, b in zip(found[g], wanted[g], strict=True)), (g, in_memory)
    assert profile.quantiles(df.limit(0), by=["g"], in_memory=0).count() == 0


def test_radix_quantiles_of_many_groups(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("g"), F.when(F.col("id") < 20_000, 7.0).otherwise(F.col("id") * 0.37 % 11).alias("value"))
    found = profile.quantiles(df, (0.5,), ["g"], in_memory=0)
    both = found.join(profile.quantiles(df, (0.5,), ["g"]).withColumnRenamed("q", "wanted"), "g")
    assert both.filter("q[0] = wanted[0]").count() == 20_000


def test_radix_plan_has_no_window_and_broadcasts_nothing(spark):
    long = spark.range(100).select(F.lit("x").alias("variable"), F.col("id").cast("double").alias("value"))
    plan = profile.quantiles(long, in_memory=0)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "python" not in plan.lower()


def test_nan_is_missing_everywhere(spark):
    df = frame(spark, {"v": [NAN, 1.0, 2.0, 4.0, None]})
    found = profile.describe(to_long(df, ["v"])).first()
    assert (found["n_valid"], found["max"], found["median"]) == (3, 4.0, 2.0)
    assert profile.box_stats(df, "v").first()["n_valid"] == 3
    assert sum(r["n"] for r in profile.histogram(df, "v", 3).collect()) == 3


def long_of(spark, **columns):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, vs in columns.items() for v in vs], "variable string, value double").repartition(3)


def test_density_is_near_the_direct_sum(spark):
    rng = np.random.default_rng(5)
    data = {"normal": rng.normal(10, 3, 800), "skewed": rng.exponential(2, 500), "few": [1.0, 2.0, 5.0]}
    long = long_of(spark, **data, constant=[3] * 9, single=[1], none=[None], odd=[INF, -INF, NAN, 1.0])
    rows = density.density(long, grid=400).toPandas()
    assert set(rows["variable"]) == set(data)
    for name, curve in rows.groupby("variable"):
        curve = curve.sort_values("point")
        values = np.array(data[name])
        h = values.std(ddof=1) * len(values) ** -0.2
        assert curve["bandwidth"].iloc[0] == pytest.approx(h)
        direct = np.exp(-(((curve["x"].to_numpy()[:, None] - values) / h) ** 2) / 2).sum(1) / (len(values) * h * math.sqrt(2 * math.pi))
        assert np.abs(direct - curve["density"]).max() <= curve["error_bound"].iloc[0]
        total = np.trapezoid(curve["density"], curve["x"])
        assert total == pytest.approx(1.0, abs=1e-3)


def bins_of(values) -> int:
    n, span = len(values), max(values) - min(values)
    sturges, fd = span / (math.log2(n) + 1), 2 * float(np.subtract(*np.quantile(values, [0.75, 0.25]))) / n ** (1 / 3)
    return math.ceil(span / (min(fd, sturges) if fd > 0 else sturges))


def test_automatic_bins(spark):
    rng = np.random.default_rng(6)
    data = {"normal": rng.normal(0, 1, 1000), "meet": [*[5.0] * 90, *range(10)], "whole": list(range(30)), "two": [1.0, 2.0]}
    long = long_of(spark, **data, constant=[3.0] * 4, none=[None], far=[*rng.normal(0, 1e-6, 500), 1e6], odd=[INF, 1.0, 2.0])
    found = {r["variable"]: r for r in density.auto_bins(long, most=1000).collect()}
    for name, values in data.items():
        assert found[name]["bins"] == bins_of(values), name
    assert (found["constant"]["lo"], found["constant"]["hi"], found["constant"]["bins"]) == (2.5, 3.5, 1)
    assert found["far"]["bins"] == 1000 and found["odd"]["n"] == 2 and "none" not in found
    counts = density.auto_histogram(long, most=1000).toPandas()
    for name, values in data.items():
        own = counts[counts["variable"] == name].sort_values("bin")
        assert own["n"].tolist() == np.histogram(values, bins_of(values))[0].tolist()
    assert counts[counts["variable"] == "constant"]["n"].tolist() == [4]


@pytest.fixture
def no_automatic_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def spread(df, by: str) -> dict:
    """In how many tasks each group's rows are."""
    return {r[0]: r[1] for r in df.groupBy(by, F.spark_partition_id().alias("task")).count().groupBy(by).count().collect()}


def test_values_of_an_automatic_histogram_stay_in_their_tasks(spark, no_automatic_broadcast):
    long = long_of(spark, a=range(300), b=range(30))
    met = density._with(long, density.auto_bins(long), ["variable"])
    assert spread(met, "variable") == {"a": 3, "b": 3} and met.count() == 330


def test_density_curves_shuffle_weights_alone(spark, no_automatic_broadcast):
    long = long_of(spark, a=range(300), b=range(30))
    plan = density.density(long, grid=40)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1  # of the values; of the grid's weights


def test_only_values_of_light_groups_are_shuffled_by_other_columns(spark, no_automatic_broadcast):
    df = spark.createDataFrame([(g, float(x)) for g, n in (("heavy", 300), ("light", 30), (None, 40)) for x in range(n)], "g string, value double").repartition(3)
    frame = df.groupBy("g").agg(F.count("*").alias("n"), F.max("value").alias("hi"))
    met = with_rows(df, frame, ["g"], heavy=100)
    assert spread(met, "g") == {"heavy": 3, "light": 1}
    assert sorted(met.select("g", "value", "n", "hi").collect()) == sorted(df.join(frame, "g").select("g", "value", "n", "hi").collect())


def test_values_of_boxes_stay_in_their_tasks(spark, no_automatic_broadcast, monkeypatch):
    monkeypatch.setattr(with_rows, "__defaults__", (100,))  # heavy from 100 on
    df = spark.createDataFrame([(g, float(x)) for g, n in (("heavy", 300), ("light", 30)) for x in [*range(n - 1), 9999]], "g string, v double").repartition(3)
    assert spread(profile._boxed(df, "v", ["g"]), "g") == {"heavy": 3, "light": 1}
    boxes = {r["g"]: (r["n_valid"], r["whisker_high"], r["n_fliers"]) for r in profile.box_stats(df, "v", ["g"]).collect()}
    assert boxes == {"heavy": (300, 298.0, 1), "light": (30, 28.0, 1)}


def test_fliers_are_those_that_boxes_count(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(x)) for g in ("a", "b", None) for x in np.round(rng.standard_cauchy(300), 1)] + [("a", NAN), ("a", None), ("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for by in (["g"], []):
        beyond = profile.fliers(df, "v", by)
        counted = {tuple(r[:-1]): r["n"] for r in beyond.groupBy(*by).agg(F.sum("n").alias("n")).collect()}
        boxes = {tuple(r[c] for c in by): r["n_fliers"] for r in profile.box_stats(df, "v", by).collect() if r["n_fliers"]}
        assert counted == {k: v for k, v in boxes.items() if v}
    assert "rangepartitioning" in profile.fliers(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()


def test_label_sets(spark):
    rows = [("m", "young", 1.0), ("m", "old", 3.0), ("f", "old", 5.0), (None, "old", 7.0), ("f", None, NAN)]
    df = spark.createDataFrame(rows, "gender string, age string, v double")
    found = {(r["label_set"], r["label"]): r for r in groups.label_sets(df, ["v"], ["gender", "age"]).collect()}
    assert set(found) == {("all", None), ("gender", "m"), ("gender", "f"), ("gender", None), ("age", "young"), ("age", "old"), ("age", None)}
    assert (found["all", None]["n_rows"], found["all", None]["n_valid"], found["all", None]["mean"], found["all", None]["median"]) == (5, 4, 4.0, 4.0)
    assert (found["gender", None]["n_rows"], found["gender", None]["mean"]) == (1, 7.0)
    assert (found["age", "old"]["n_valid"], found["age", "old"]["q1"], found["age", "old"]["max"]) == (3, 4.0, 7.0)
    assert found["age", None]["n_valid"] == 0 and found["age", None]["mean"] is None
    plan = groups.label_sets(df, ["v"], ["gender", "age"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_label_sets_of_large_inputs_hold_no_group_in_a_task(spark):
    df = spark.range(20_000_000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).cast("string").alias("g"))
    plan = lambda d: groups.label_sets(d, ["v"], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan(df) and "percentile(" in plan(df.sparkSession.range(9).select(F.col("id").cast("double").alias("v"), F.lit("a").alias("g")))


def test_label_sets_by_radix_are_those_in_memory(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["m", "f", None]), rng.choice([1, 2, None]), rng.choice([None, NAN, -0.0, 1.5, rng.random()]), float(rng.randrange(9))) for _ in range(500)]
    df = spark.createDataFrame([*rows, ("odd", 7, INF, None), ("odd", 7, -INF, None)], "g string, k int, v double, w double").repartition(3)
    told = lambda r: repr([x + 0.0 if isinstance(x, float) else x for x in r])  # noqa: E731  both zeros alike
    found = [sorted(map(told, groups.label_sets(df, ["v", "w"], ["g", "k"], in_memory=m).collect())) for m in (1 << 30, 0)]
    assert [(a, b) for a, b in zip(*found) if a != b] == [] and len(found[0]) == len(found[1]) == 2 * (1 + 4 + 4)


@pytest.mark.parametrize("p", [5, 130])
def test_results_from_patterns_equal_those_from_rows(spark, p):
    random.seed(p)
    columns = [f"c{k}" for k in range(p)]
    kinds = [[random.random() < 0.4 for _ in columns] for _ in range(6)] + [[False] * p]
    for kind in kinds:
        kind[2] = False  # never missing
    rows = [tuple(None if gone else (NAN if k == 3 and n % 7 == 0 else float(k)) for k, gone in enumerate(random.choice(kinds))) for n in range(90)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(4)
    clean = df.select(*(F.nanvl(c, F.lit(None)).alias(c) for c in columns))
    patterns = Patterns.of(df, columns)
    ordered = lambda d: sorted(map(tuple, d.collect()), key=repr)
    some, sets = columns[1:4], {"all": columns, "some": columns[1:4], "last": columns[-1:]}
    assert ordered(patterns.complete_cases(sets)) == ordered(missing.complete_cases(clean, sets))
    assert ordered(patterns.readings_histogram(some)) == ordered(missing.readings_histogram(clean, some))
    assert ordered(patterns.coverage(some)) == ordered(missing.coverage(clean, some))
    assert [tuple(r) for r in patterns.missing_table().collect()] == [tuple(r) for r in missing.missing_table(clean, columns).collect()]
    a, b = (pairs_of(x) for x in (patterns.missing_corr(), missing.missing_corr(clean, columns)))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], abs=1e-9) for k in a)
    assert ordered(missing.co_missing(patterns.missing_corr())) == ordered(missing.co_missing(missing.missing_corr(clean, columns)))
    named = patterns.named().collect()
    assert sum(r["n"] for r in named) == 90 and all(len(r["pattern"]) == p for r in named)
    empty = Patterns.of(df.limit(0), columns)
    assert empty.missing_corr().count() == 0 and tuple(empty.coverage(some).first()) == (0, 0, 0, 0, 0)
