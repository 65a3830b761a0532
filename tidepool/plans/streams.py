"""Queries of the stream operators over the event table, in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.plans.registry import query
from tidepool.sources import tables
from tidepool.streaming import states


def timed(spark, sf):
    return tables.interactions(spark, sf).select("id", "conversation_id", F.col("model").alias("kind"), (F.unix_micros("ts") / 1e6).alias("s"), F.col("refused").alias("failed"))


@query("T04_session_gap", """
WITH g AS (SELECT conversation_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY conversation_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM interactions),
s AS (SELECT *, sum(new) OVER (PARTITION BY conversation_id ORDER BY ts) AS k FROM g)
SELECT conversation_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events FROM s GROUP BY conversation_id, k""")  # fmt: skip
def session_gap(spark, sf):
    return states.sessions(tables.interactions(spark, sf), "conversation_id", "ts")


def errors_of(calls):
    """Calls as errors of four kinds, of a table or a stream."""
    kinds = F.array(*map(F.lit, ("503", "429", "timeout", "odd")))
    return calls.select("id", "ts", F.element_at(kinds, (F.col("id") % 4 + 1).cast("int")).alias("kind"), (F.unix_micros("ts") / 1e6).alias("s"))


def accesses_of(accesses):
    return accesses.select("id", "ts", "channel_id", (F.unix_micros("ts") / 1e6).alias("s"), F.element_at("memory_ids", 1).alias("memory_id"))


@query("T05_error_window")
def error_window(spark, sf):
    return states.error_alerts(errors_of(tables.interactions(spark, sf)), window=36_000.0, cooldown=72_000.0)


@query("T06_access_flush")
def access_flush(spark, sf):
    return states.access_flushes(accesses_of(tables.accesses(spark, sf)), "channel_id", most=50, wait=86_400.0)


@query("T07_repetitions", "SELECT sha256(left(lower(trim(content)), 100)) AS key, count(*) AS n FROM messages GROUP BY 1")
def repetitions(spark, sf):
    return states.repetitions(tables.messages(spark, sf).select(F.sha2(F.substring(F.lower(F.trim("content")), 1, 100), 256).alias("key")), "key")


@query("T08_access_statistics", "WITH used AS (SELECT unnest(memory_ids) AS memory_id, channel_id FROM accesses) SELECT memory_id, count(*) AS accesses, string_agg(DISTINCT channel_id::VARCHAR, ',' ORDER BY channel_id::VARCHAR) AS channels FROM used GROUP BY 1")
def access_statistics(spark, sf):
    return states.access_statistics(tables.accesses(spark, sf)).withColumn("channels", F.array_join(F.col("channels").cast("array<string>"), ","))


@query("T09_token_bucket")
def token_bucket(spark, sf):
    return states.token_bucket(timed(spark, sf), "conversation_id", rate=0.0005, burst=3.0)


@query("T10_circuit_breaker")
def circuit_breaker(spark, sf):
    return states.circuit_breaker(timed(spark, sf).withColumn("failed", F.col("id") % 3 == 0), "conversation_id", failures=2, wait=3600.0)


@query("T11_illegal_moves", """
WITH s AS (SELECT id, conversation_id, model, lag(model) OVER (PARTITION BY conversation_id ORDER BY ts, id) AS before FROM interactions)
SELECT id FROM s WHERE before IS NOT NULL AND NOT (before = 'view' OR before = model)""")  # fmt: skip
def illegal_moves(spark, sf):
    rows = tables.interactions(spark, sf).select("id", "conversation_id", "ts", "model")
    kinds = rows.select("model").distinct()
    allowed = kinds.select(F.lit("view").alias("before"), F.col("model").alias("after")).unionByName(kinds.select(F.col("model").alias("before"), F.col("model").alias("after"))).distinct()
    return states.illegal_moves(rows, "conversation_id", ["ts", "id"], "model", allowed).select("id")


@query("T13_cache_hits")
def cache_hits(spark, sf):
    return states.cache_hits(timed(spark, sf), "conversation_id", ttl=7200.0)
