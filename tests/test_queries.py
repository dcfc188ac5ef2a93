"""Each query against its SQL, both at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from loomstat import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def comparable(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if pd.isna(x):
            return ""
        return str(x) if isinstance(x, (str, bool)) or not hasattr(x, "__float__") else f"{float(x):.9g}"

    columns = sorted(df.columns)
    return sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_matches_sql(spark, duck, name):
    found = Q.queries()[name](spark, SF).toPandas()
    wanted = duck.sql(Q.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) > 0
    assert comparable(found) == comparable(wanted)


def test_every_query_has_sql():
    assert Q.queries().keys() == Q.oracle_sql().keys()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert Q.queries().keys() <= __spark_entry__.queries().keys()
