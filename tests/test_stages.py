"""The three stages end to end, on a small synthetic survey in CSV files."""

import os
import random
import subprocess
import sys
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from loomstat.__main__ import main
from loomstat.catalog import SURVEY
from loomstat.operators.quality import DuplicateKeyError, MissingColumnsError
from loomstat.plans import stages
from loomstat.sources import tables

N = 120


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Nine files; every third person lacks laboratory files; columns stand in other orders, with extra ones between."""
    random.seed(4)
    at = tmp_path_factory.mktemp("survey")
    for d in SURVEY.datasets:
        lines = [",".join(["EXTRA", *reversed(d.columns), "SEQN"])]
        for k in range(N):
            if not d.master and k % 3 == 0:
                continue
            values = {c: f"{random.gauss(100, 20):.2f}" for c in d.columns}
            values |= {c: v for c, v in {"RIAGENDR": 1 + k % 2, "RIDAGEYR": 10 + k % 75, "RIDRETH3": 1 + k % 7, "DXAEXSTS": 1 + k % 4, "LBDINLC": k % 2}.items() if c in values}
            if k % 10 == 1:
                values[d.columns[-1]] = random.choice(["", "NA", "NaN"])
            lines.append(",".join(["x", *(str(values[c]) for c in reversed(d.columns)), str(1000 + k)]))
        lines += [",".join(["x", *("" for _ in d.columns), "9999"])] * (not d.master)  # right-only
        (at / d.file).write_text("\n".join(lines) + "\n")
    return str(at)


def test_all_stages(spark, folder, tmp_path):
    out = str(tmp_path)
    merged = stages.run_merge(spark, folder, out)
    assert merged.count() == N and len(merged.columns) == 34
    assert merged.filter("SEQN = 9999").isEmpty() and merged.filter("isnan(LBXSKSI)").isEmpty()
    report = {r["dataset"]: r for r in stages.merge_report(tables.read_datasets(spark, folder, SURVEY)).collect()}
    assert report["hdl"]["n_matched"] == N - N // 3
    cleaned = stages.run_preprocess(spark, out, snapshots=True)
    assert len(cleaned.columns) == 39 and cleaned.filter("RIDAGEYR not between 20 and 80").isEmpty()
    assert cleaned.filter("DXAEXSTS <> 1 and DXDTOPF is not null").isEmpty()
    assert cleaned.filter("LBDINLC = 1 and (LBXIN is not null or HOMA_IR is not null)").isEmpty()
    assert stages.preprocess(merged).exceptAll(cleaned).isEmpty()
    found = stages.run_profile(spark, out)
    assert found.correlations.count() == 351
    assert found.recommendations[-1].applies
    assert "Profile" in (tmp_path / "profile" / "SUMMARY.md").read_text()
    assert (tmp_path / "profile" / "outliers" / "report.txt").exists()
    shapes = [r["variable"] for r in found.distributions.collect()]
    drawn = {str(p.relative_to(tmp_path / "profile")) for p in (tmp_path / "profile").rglob("*.svg")}
    assert drawn == {
        *(f"distributions/individual/{v}.svg" for v in shapes), *(f"outliers/individual/{v}_boxplot.svg" for v in shapes), "outliers/outliers_summary_grid.svg",
        "missingness/missingness_heatmap.svg", "missingness/missingness_correlation.svg", "correlations/correlation_heatmap.svg",
        *(f"demographics/{f}.svg" for f in ("age_distribution", "gender_distribution", "ethnicity_distribution", "biomarkers_by_gender", "biomarkers_by_age_group")),
    }
    for path in drawn:
        tree = ElementTree.parse(tmp_path / "profile" / path)
        assert len(list(tree.iter())) > 5, path
    assert found.plots["flier_bins"].groupBy("variable").count().filter("count > 200").isEmpty()
    assert found.plots["stretches"].count() <= 200


def test_reports_come_from_the_writes(spark, folder, tmp_path):
    out = str(tmp_path)
    merged = stages.run_merge(spark, folder, out)
    matched = {r["dataset"]: r.asDict() for r in spark.read.csv(f"{out}/reports/matches", header=True, inferSchema=True).collect()}
    wanted = {r["dataset"]: r.asDict() for r in stages.merge_report(tables.read_datasets(spark, folder, SURVEY)).collect()}
    assert matched == wanted and not any(c.startswith("_matched_") for c in merged.columns)
    context = spark.sparkContext
    context.setJobGroup("observed", "")
    stages.run_preprocess(spark, out)
    observed = len(context.statusTracker().getJobIdsForGroup("observed"))
    context.setJobGroup("plain", "")
    tables.write_table(stages.preprocess(tables.read_table(spark, f"{out}/merged")), f"{out}/again")
    plain = len(context.statusTracker().getJobIdsForGroup("plain"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert observed == plain + 1  # the report's own file
    changes = {(r["decision"], r["variable"]): r for r in spark.read.csv(f"{out}/reports/changes", header=True, inferSchema=True).collect()}
    cleaned, start = tables.read_table(spark, f"{out}/preprocessed"), tables.read_table(spark, f"{out}/merged")
    assert changes[3, "LBXIN"]["n_rows_before"] == N and changes[3, "LBXIN"]["n_rows_after"] == cleaned.count()
    aged = start.filter("RIDAGEYR between 20 and 80")
    assert changes[4, "DXDTOPF"]["n_null_before"] == aged.filter("DXDTOPF is null").count()
    assert changes[4, "DXDTOPF"]["n_null_after"] == cleaned.filter("DXDTOPF is null").count()
    assert changes[5, "LBXIN"]["n_null_after"] == cleaned.filter("LBXIN is null").count()
    assert changes[6, "HOMA_IR"]["n_null_before"] is None and changes[6, "HOMA_IR"]["n_null_after"] == cleaned.filter("HOMA_IR is null").count()


RETRIED = """
import sys
from pyspark import TaskContext
from pyspark.sql import Observation, SparkSession, functions as F
spark = SparkSession.builder.master("local[2, 4]").config("spark.ui.enabled", "false").getOrCreate()
from loomstat.operators.transforms import observed

def fails_once(batches):
    for batch in batches:
        yield batch
    if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
        raise RuntimeError("lost")

df = spark.range(0, 100, 1, 4).mapInArrow(fails_once, "id long")
out, points = observed(df, [("1", "even", lambda d: d.filter("id % 2 = 0"))], ["id"])
out.write.mode("overwrite").parquet(sys.argv[1])
print("COUNTS", [p.get["rows"] for p in points])
"""


def test_a_task_tried_again_counts_once(tmp_path):
    said = subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path / "t")], capture_output=True, text=True, timeout=300, env=os.environ)
    assert "COUNTS [100, 50]" in said.stdout, said.stderr[-2000:]


def test_merge_of_buckets_shuffles_nothing(spark, folder, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        landed = stages.land(spark, folder, str(tmp_path), buckets=4, prefix="bucket_test")
        merged = stages.merge(landed)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 8 and "Exchange" not in plan
        counted = landed["hdl"].groupBy("SEQN").count()
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
        plain = stages.merge(tables.read_datasets(spark, folder, SURVEY))
        assert plain.exceptAll(stages.run_merge(spark, folder, str(tmp_path / "other"), buckets=4)).isEmpty()
        merged = merged.withColumn("SEQN", F.col("SEQN").cast("double"))
        assert merged.exceptAll(plain).isEmpty() and plain.exceptAll(merged).isEmpty()
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for d in SURVEY.datasets:
            for prefix in ("bucket_test", "loomstat"):
                spark.sql(f"DROP TABLE IF EXISTS {prefix}_{d.name}")


def test_scan_checks(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, f"{folder}/none.csv", ["SEQN"])
    with pytest.raises(MissingColumnsError):
        tables.read_csv(spark, f"{folder}/HDL_J.csv", ["SEQN", "OTHER"])
    assert tables.list_columns(spark, folder, SURVEY)["hdl"] == ["EXTRA", "LBDHDD", "SEQN"]
    assert tables.list_columns(spark, str(tmp_path), SURVEY)["hdl"] is None
    shown = tables.preview(spark, folder)
    assert len(shown) == 9 and len(shown["HDL_J.csv"]) == 10
    (tmp_path / "t.csv").write_text("SEQN,A\n1,junk\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_csv(spark, str(tmp_path / "t.csv"), ["SEQN", "A"]).collect()


def test_duplicate_keys_stop_the_merge(spark, folder, tmp_path):
    for d in SURVEY.datasets:
        (tmp_path / d.file).write_text(",".join(["SEQN", *d.columns]) + "\n" + ",".join(["7", *("1" for _ in d.columns)]) + "\n")
    (tmp_path / "HDL_J.csv").write_text("SEQN,LBDHDD\n7,1\n7,2\n")
    with pytest.raises(DuplicateKeyError, match="hdl"):
        stages.run_merge(spark, str(tmp_path), str(tmp_path / "out"))


def test_command_line(spark, folder, tmp_path, capsys):
    main(["explore", "--data", folder])
    main(["explore", "--data", str(tmp_path)])
    main(["preview", "--data", folder])
    main(["all", "--data", folder, "--out", str(tmp_path), "--snapshots"])
    said = capsys.readouterr().out
    assert "hdl: EXTRA, LBDHDD, SEQN" in said and "hdl: no file" in said and "HDL_J.csv\n" in said
    assert f"merged: {N} rows, 34 columns" in said and "preprocessed: " in said
    assert (tmp_path / "profile" / "SUMMARY.md").exists() and len(list((tmp_path / "snapshots").iterdir())) == 5
    with pytest.raises(SystemExit):
        main(["other"])
