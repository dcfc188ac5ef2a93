"""The stages from a command line: ``python -m loomstat STEP --data FOLDER --out FOLDER``, also by spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .catalog import SURVEY
from .plans import stages
from .sources import tables

STEPS = ("explore", "preview", "merge", "preprocess", "profile", "all")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomstat", description="Merge, clean and profile a measurement panel.")
    parser.add_argument("step", choices=STEPS, help="explore: the columns of each CSV file; preview: its first rows; all: merge, preprocess and profile")
    parser.add_argument("--data", default="dataset", help="folder of the CSV files")
    parser.add_argument("--out", default="output", help="folder of what the stages write")
    parser.add_argument("--snapshots", action="store_true", help="keep the table after each cleaning rule")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("loomstat").getOrCreate()
    if given.step == "explore":
        for name, columns in tables.list_columns(spark, given.data, SURVEY).items():
            print(f"{name}: {'no file' if columns is None else ', '.join(columns)}")
    if given.step == "preview":
        for name, rows in tables.preview(spark, given.data).items():
            print(name, *([rows] if isinstance(rows, str) else rows), sep="\n  ")
    if given.step in ("merge", "all"):
        merged = stages.run_merge(spark, given.data, given.out)
        print(f"{given.out}/merged: {merged.count():,} rows, {len(merged.columns)} columns")
    if given.step in ("preprocess", "all"):
        cleaned = stages.run_preprocess(spark, given.out, snapshots=given.snapshots)
        print(f"{given.out}/preprocessed: {cleaned.count():,} rows, {len(cleaned.columns)} columns")
    if given.step in ("profile", "all"):
        print(f"{given.out}/profile: {stages.run_profile(spark, given.out).verdict}")


if __name__ == "__main__":
    main()
