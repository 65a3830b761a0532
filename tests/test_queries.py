"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidepool.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    """A value as text: missing ones alike, and no negative zero."""
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return f"{x:.5f}".replace("-0.00000", "0.00000").removesuffix(".00000")
    return str(x).removesuffix(" 00:00:00")


def rounded(rows):
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.select(*columns).toPandas().itertuples(index=False)]
    assert rows, "no rows to compare"
    assert rounded(rows) == rounded(tuple(r) for r in want.df().itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    found = registry.QUERIES[name](spark, SF)
    assert found.columns and found.count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10
