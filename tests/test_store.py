"""Tables that change by parts, and scans that another session goes on with."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidepool.sources.store import Scan, Table


def files(path):
    """Every data file with its time and size."""
    return {f: (os.stat(f).st_mtime_ns, os.stat(f).st_size) for f in glob.glob(f"{path}/*/*.parquet")}


def part_of(file):
    return int(os.path.basename(os.path.dirname(file)).split("=")[1])


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t", "id", 100)
    t.create(spark.range(-50, 950).select("id", F.col("id").cast("string").alias("text"), F.lit(1).alias("n")))
    return t


def rows(t):
    return {r.id: (r.text, r.n) for r in t.read().collect()}


def test_changes_leave_other_parts_alone(spark, table):
    want = {k: (str(k), 1) for k in range(-50, 950)}
    assert rows(table) == want

    def changed(do, parts):
        before = files(table.path)
        assert do() == len(parts)
        after = files(table.path)
        assert {f for f in before if part_of(f) not in parts} == {f for f in after if part_of(f) not in parts}
        assert all(before[f] == after[f] for f in before if part_of(f) not in parts)
        assert not {f for f in before if part_of(f) in parts} & set(after)

    new = spark.createDataFrame([(5, "new", 2), (205, "new", 2), (1205, "far", 2), (5, "older", 1), (None, "no key", 1)], "id long, text string, n int")
    changed(lambda: table.upsert(new, F.desc("n")), {0, 2, 12})
    want |= {5: ("new", 2), 205: ("new", 2), 1205: ("far", 2)}
    assert rows(table) == want
    changed(lambda: table.insert_missing(spark.createDataFrame([(5, "x", 3), (-51, "y", 3), (-51, "y", 3)], "id long, text string, n int")), {0, -1})
    want |= {-51: ("y", 3)}
    assert rows(table) == want
    changed(lambda: table.update(spark.createDataFrame([(7, None, 9), (301, "z", None), (99_999, "none", 1)], "id long, text string, n int"), ["text", "n"]), {0, 3, 999})
    want |= {7: ("7", 9), 301: ("z", 1)}
    assert rows(table) == want
    gone = list(range(400, 500)) + [501, 77_777]
    changed(lambda: table.delete(spark.createDataFrame([(k,) for k in gone], "id long")), {4, 5, 777})
    assert rows(table) == {k: v for k, v in want.items() if k not in gone}
    assert not os.path.exists(f"{table.path}/_part=4")
    assert table.delete(spark.createDataFrame([], "id long")) == 0


def test_changes_read_their_parts_only(spark, table):
    some, parts = table.touched(spark.createDataFrame([(5,), (250,)], "id long"))
    assert sorted(parts) == [0, 2] and len(some.inputFiles()) > 2
    assert {part_of(r[0].removeprefix("file://")) for r in some.select(F.input_file_name()).distinct().collect()} == {0, 2}
    plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [_part" in plan


def test_rows_need_keys(spark, tmp_path):
    with pytest.raises(Exception, match="without key"):
        Table(spark, f"{tmp_path}/t", "id", 10).create(spark.createDataFrame([(None, 1)], "id long, n int"))


def test_a_scan_goes_on_in_another_session(spark, tmp_path):
    ids = [k * k for k in range(500)]
    df = spark.createDataFrame([(k,) for k in ids], "id long")
    folder, worked = f"{tmp_path}/scan", []

    def work(some):
        worked.append(sorted(r.id for r in some.collect()))
        return some.withColumn("twice", F.col("id") * 2)

    first = Scan(spark, folder)
    first.plan(df, "id", 100)
    assert first.run(df, "id", work, most=2) == 3
    other = spark.newSession()
    again = Scan(other, folder)
    again.plan(other.createDataFrame([(1,)], "id long"), "id", 1)  # was planned before
    with pytest.raises(RuntimeError):
        again.run(other.createDataFrame([(k,) for k in ids], "id long"), "id", lambda some: (_ for _ in ()).throw(RuntimeError("lost")))
    more = other.createDataFrame([(k,) for k in [*ids, 10**9]], "id long")
    assert again.run(more, "id", work) == 0 and again.run(more, "id", work) == 0
    assert len(worked) == 5 and sum(map(len, worked)) == 501 and all(80 <= len(w) <= 121 for w in worked)
    assert sorted((r.id, r.twice) for r in again.found().collect()) == sorted((k, 2 * k) for k in [*ids, 10**9])


def test_a_scan_of_nothing(spark, tmp_path):
    scan = Scan(spark, f"{tmp_path}/scan")
    none = spark.createDataFrame([], "id long")
    scan.plan(none, "id", 10)
    assert len(scan.pending()) == 1 and scan.run(none, "id", lambda x: x) == 0 and scan.found().count() == 0
