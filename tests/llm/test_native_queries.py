"""SQL of the operators' queries against DuckDB, and the search for the next document on ids that aren't spread evenly."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidepool.llm import fingerprint, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    shown = lambda rows: sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    got = shown(map(tuple, queries.QUERIES[name](spark, SF).select(*columns).collect()))
    assert got and got == shown(want.fetchall())


@pytest.mark.parametrize("few", [3, 2048])
def test_next_documents_of_any_ids(spark, monkeypatch, few):
    monkeypatch.setattr(fingerprint, "RANGE", few)
    ids = [*range(40), 10**15, 10**15 + 7, -5, 7, 7, None, None, 10**18]
    texts = [f"Sentence {k}. " * (k % 5) + f"\nline {k * k % 11}" for k in range(len(ids))]
    texts[3] = None
    rows = list(zip(ids, texts, strict=True))
    got = fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_chars", "edited_sha256", "fingerprint").collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        n, after = len(t), order[(k + 1) % len(order)][1]
        want.append((i, n, t[: n - n // 2] + after[: n // 2]))
    texts_of = spark.createDataFrame(want, "doc_id long, n long, edited string").select("doc_id", "n", F.sha2("edited", 256)).collect()
    key = lambda r: tuple(map(str, r[:3]))
    assert sorted(map(key, got)) == sorted(map(key, texts_of))


def test_ranges_hold_about_as_many_rows(spark):
    ends = [10, 20, 30, 40, 50, 10**15]
    ids = [None, -7, 10, 11, 20, 21, 49, 50, 51, 10**15]
    df = spark.createDataFrame([(i,) for i in ids], "id long").select(fingerprint._range_of(F.col("id"), ends).alias("r"))
    assert [r.r for r in df.collect()] == [-1, 0, 0, 1, 1, 2, 4, 4, 5, 5]
