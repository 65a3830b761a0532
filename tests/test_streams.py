"""Stateful rules over tables and streams, restarts, and one stream into several tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.streaming import sinks, stateful, states

ROWS = "id long, key string, s double, memory_id long"


def some_rows(seed, n):
    rng, rows, s = random.Random(seed), [], 0.0
    for k in range(n):
        s += rng.choice([0.1, 1.0, 5.0, 40.0, 400.0])
        rows.append((k, rng.choice(["503", "429", "x"]), round(s, 1), rng.randrange(30)))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS).withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(stateful.PROVIDER)
    spark.conf.set(stateful.PROVIDER, stateful.ROCKS)
    yield spark
    spark.conf.set(stateful.PROVIDER, before)


def alerts_by_hand(rows, window, cooldown, thresholds):
    out, state = [], {}
    for _, key, s, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        begin, n, alerted = state.get(key, (None, 0, None))
        begin, n = (s, 1) if begin is None or s - begin > window else (begin, n + 1)
        if n >= thresholds.get(key, 10) and (alerted is None or s - alerted >= cooldown):
            out.append((key, s, n))
            alerted = s
        state[key] = begin, n, alerted
    return sorted(out)


def flushes_by_hand(rows, most, wait, idle):
    out, state = [], {}
    for i, key, s, m in sorted(rows, key=lambda r: (r[2], r[0])):
        last, seen, waiting = state.get(key, (None, None, set()))
        if idle is not None and seen is not None and s - seen > idle:
            out += [(key, None, seen + idle, len(waiting))] if waiting else []
            last, waiting = None, set()
        last = s if last is None else last
        waiting = waiting | {m}
        if len(waiting) >= most or s - last >= wait:
            out.append((key, i, s, len(waiting)))
            last, waiting = s, set()
        state[key] = last, s, waiting
    for key, (_, seen, waiting) in state.items():
        out += [(key, None, seen + idle, len(waiting))] if waiting and idle is not None else []
    return sorted(out, key=str)


@pytest.mark.parametrize("rule", [(300.0, 600.0, {"503": 3, "429": 5}), (10.0, 0.0, {"503": 1}), (1000.0, 50.0, {"503": 2, "429": 2, "x": 2}), (0.0, 5.0, {"x": 1})])
def test_alerts_of_a_table(spark, rule):
    rows = some_rows(1, 900)
    rows += [(1000 + k, "503", rows[k][2], 1) for k in range(0, 60, 3)]  # at one time
    got = states.error_alerts(table(spark, rows), "key", *rule)
    assert sorted((r.key, r.s, r.n) for r in got.collect()) == alerts_by_hand(rows, *rule)


@pytest.mark.parametrize("rule", [(50, 300.0, None), (5, 60.0, None), (5, 60.0, 100.0), (1, 10.0, 3.0), (20, 1e9, 39.0), (20, 0.0, None)])
def test_flushes_of_a_table(spark, rule):
    rows = some_rows(2, 900) + [(2000, "503", None, 1), (2001, "503", 5.0, None)]
    got = states.access_flushes(table(spark, rows), "key", *rule)
    assert sorted(((r.key, r.id, r.s, r.n) for r in got.collect()), key=str) == flushes_by_hand([r for r in rows if r[2] is not None and r[3] is not None], *rule)


def test_rules_of_nothing(spark):
    none = table(spark, [])
    assert states.error_alerts(none, "key").collect() == states.access_flushes(none, "key").collect() == []


def run(spark, make, source, folder):
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in spark.read.schema(make(spark.read.parquet(source)).schema).parquet(f"{folder}/out").collect()]


@pytest.mark.parametrize("kind", ["alerts", "flushes", "idle"])
def test_streams_go_on_after_a_restart(rocks, tmp_path, kind):
    rules = {
        "alerts": lambda df: states.error_alerts(df, "key", 300.0, 600.0, {"503": 3, "429": 4}, ts="ts", late="0 seconds"),
        "flushes": lambda df: states.access_flushes(df, "key", 6, 60.0, ts="ts", late="0 seconds"),
        "idle": lambda df: states.access_flushes(df, "key", 6, 200.0, 100.0, ts="ts", late="0 seconds"),
    }
    make, rows, source = rules[kind], some_rows(3, 240), f"{tmp_path}/rows"
    found = []
    for k in range(3):  # each time another run of the stream, from the checkpoint of the one before, over two files more
        for part in (rows[80 * k : 80 * k + 40], rows[80 * k + 40 : 80 * k + 80]):
            table(rocks, part).coalesce(1).write.mode("append").parquet(source)
            found = run(rocks, make, source, tmp_path)
    # later rows of other keys, so that the watermark passes what is due
    for s in (1e6, 2e6):
        table(rocks, [(9999, "late", s, 1)]).coalesce(1).write.mode("append").parquet(source)
        found = run(rocks, make, source, tmp_path)
    want = [tuple(r) for r in make(rocks.read.parquet(source)).collect()]
    assert sorted((r for r in found if r[0] != "late"), key=str) == sorted((r for r in want if r[0] != "late"), key=str) and len(found) > 5


def test_a_stream_needs_its_store_and_times(spark, tmp_path):
    table(spark, some_rows(4, 3)).write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/rows").schema).parquet(f"{tmp_path}/rows")
    with pytest.raises(ValueError, match="event times"):
        states.error_alerts(stream, "key")
    with pytest.raises(ValueError, match="stateStore"):
        states.error_alerts(stream, "key", ts="ts")


SINKS = {
    "messages": lambda b: b.select("id", "key"),
    "accesses": lambda b: b.where("memory_id IS NOT NULL").select("id", "memory_id", F.substring("key", 1, 2).alias("query")),
    "keys": lambda b: b.groupBy("key").agg(F.count("*").alias("n")),
}


def test_a_batch_is_written_once(spark, tmp_path):
    folder = str(tmp_path)
    rows = table(spark, some_rows(5, 50))
    assert sinks.entered(spark, folder).count() == 0
    assert sinks.write_batch(rows, 0, folder, SINKS) and not sinks.write_batch(rows, 0, folder, SINKS)
    assert sinks.read(spark, folder, "messages").count() == 50 and sinks.read(spark, folder, "keys").agg(F.sum("n")).first()[0] == 50

    def broken(batch):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):  # after the first table, before the ledger
        sinks.write_batch(rows, 1, folder, {"messages": SINKS["messages"], "accesses": broken})
    assert sinks.read(spark, folder, "messages").count() == 50
    assert sinks.write_batch(rows, 1, folder, SINKS)
    assert sinks.read(spark, folder, "messages").count() == 100 and sinks.entered(spark, folder).count() == 6


def test_a_stream_into_several_tables(spark, tmp_path):
    source, folder, rows = f"{tmp_path}/rows", f"{tmp_path}/tables", some_rows(6, 90)

    def run(checkpoint):
        stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
        sinks.fan_out(stream, folder, SINKS).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()

    for k in range(3):
        table(spark, rows[30 * k : 30 * k + 30]).coalesce(1).write.mode("append").parquet(source)
        run("one")
    run("two")  # a checkpoint that was lost: the batches come again by their numbers
    for name in ("messages", "accesses"):
        assert sorted(r.id for r in sinks.read(spark, folder, name).collect()) == list(range(90))
    assert sinks.entered(spark, folder).select("batch").distinct().count() == 3
    with pytest.raises(ValueError, match="ledger"):
        sinks.fan_out(spark.readStream.format("rate").load(), folder, {"ledger": SINKS["keys"]})
