"""The logical tables as projections of the available ones, in Spark and as SQL common table expressions.

"Now" is never the clock: it is ``NOW`` here and a parameter of the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(rows: DataFrame, most: int = 1000) -> list:
    """The rows of a list that becomes part of a plan; one of more than ``most`` is an error, since it wants a join."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for a list in a plan")
    return found


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    ts = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(conv_id as int), cast(turn as int), 0)")
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), "role", F.col("text").alias("content"), ts.alias("ts"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("turns"), F.min_by("content", "turn_id").alias("first_content"))
    return rows.select("session_id", "started_at", "ended_at", "turns", F.when(F.col("session_id") % 3 != 0, F.substring("first_content", 1, 80)).alias("summary"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    i = F.col("doc_id")
    ago = lambda days: F.expr(f"timestamp '{NOW}' - make_interval(0, 0, 0, cast(doc_id % {days} as int), 0, 0, 0)")
    rows = docs.join(labels.select("doc_id", F.col("quality")), "doc_id", "left")
    return rows.select(
        i.alias("id"),
        F.col("text").alias("content"),
        F.element_at(F.array(*map(F.lit, ("fact", "preference", "insight", "conversation"))), (i % 4 + 1).cast("int")).alias("memory_type"),
        ((i % 100) / 100.0).alias("importance"),
        (i % 4 + 1).cast("int").alias("repetitions"),
        (i % 7).cast("int").alias("access_count"),
        (i % 12).cast("int").alias("connection_count"),
        (i % 3).cast("int").alias("channels"),
        ago(60).alias("created_at"),
        ago(13).alias("last_accessed"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("preserved"),
        F.col("source").alias("topic"),
        F.col("lang").alias("lang"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions_of(read(spark, sf_dir, "events"))


def interactions_of(events: DataFrame) -> DataFrame:
    """Calls of models, of a table or a stream of events."""
    e, u = F.col("event_id"), F.col("user_id")
    return events.select(
        e.alias("id"), F.col("ts").cast("timestamp").alias("ts"), u.alias("conversation_id"), F.col("event_type").alias("model"), F.concat(F.lit("tier"), u % 3).alias("tier"), F.concat(F.lit("reason"), u % 20).alias("reason"),
        F.col("value").alias("latency_ms"), (e % 997).alias("tokens_in"), (e % 499).alias("tokens_out"), (e % 50 == 0).alias("refused"), (e % 4).alias("tool_calls"),
    )


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access patterns with the ids of the memories that matched as an array."""
    return accesses_of(read(spark, sf_dir, "events"))


def accesses_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.array(k, k + 1).alias("memory_ids"), (F.col("user_id") % 5).alias("channel_id"), F.col("user_id"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, kind: str, key: str, label: str) -> DataFrame:
        return read(spark, sf_dir, name).select(F.concat(F.lit(kind[0] + ":"), F.col(key)).alias("entity_id"), F.col(label).alias("name"), F.lit(kind).alias("entity_type"), F.col(key).cast("long").alias("k"))

    rows = part("nation", "nation", "n_nationkey", "n_name").unionByName(part("region", "region", "r_regionkey", "r_name")).unionByName(part("supplier", "supplier", "s_suppkey", "s_name")).unionByName(part("part", "part", "p_partkey", "p_name"))
    old = F.expr(f"timestamp '{NOW}' - make_interval(0, 0, 0, cast(k % 60 as int), 0, 0, 0)")
    return rows.select("entity_id", "name", "entity_type", (F.col("k") % 9 + 1).alias("mentions"), old.alias("last_accessed"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("source_id"), F.concat(F.lit("r:"), "n_regionkey").alias("target_id"), F.lit("part_of").alias("relation_type"), F.lit(1.0).alias("weight"))
    supplier = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("source_id"), F.concat(F.lit("n:"), "s_nationkey").alias("target_id"), F.lit("located_in").alias("relation_type"), F.lit(0.8).alias("weight"))
    sold = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").count()
    sold = sold.select(F.concat(F.lit("s:"), "l_suppkey").alias("source_id"), F.concat(F.lit("p:"), "l_partkey").alias("target_id"), F.lit("supplies").alias("relation_type"), F.least(F.lit(1.0), F.col("count") / 20.0).alias("weight"))
    return nation.unionByName(supplier).unionByName(sold)


VIEWS_SQL = f"""WITH messages AS (
  SELECT conv_id AS session_id, turn AS turn_id, role, text AS content, TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts FROM conversations
), sessions AS (
  SELECT session_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS turns, CASE WHEN session_id % 3 <> 0 THEN left(arg_min(content, turn_id), 80) END AS summary FROM messages GROUP BY session_id
), memories AS (
  SELECT d.doc_id AS id, d.text AS content, ['fact', 'preference', 'insight', 'conversation'][d.doc_id % 4 + 1] AS memory_type, (d.doc_id % 100) / 100.0::DOUBLE AS importance,
    (d.doc_id % 4 + 1)::INT AS repetitions, (d.doc_id % 7)::INT AS access_count, (d.doc_id % 12)::INT AS connection_count, (d.doc_id % 3)::INT AS channels,
    TIMESTAMP '{NOW}' - to_days((d.doc_id % 60)::INT) AS created_at, TIMESTAMP '{NOW}' - to_days((d.doc_id % 13)::INT) AS last_accessed, coalesce(l.quality = 1, false) AS preserved, d.source AS topic, d.lang
  FROM documents d LEFT JOIN labels l USING (doc_id)
), interactions AS (
  SELECT event_id AS id, ts, user_id AS conversation_id, event_type AS model, 'tier' || (user_id % 3) AS tier, 'reason' || (user_id % 20) AS reason, value AS latency_ms,
    event_id % 997 AS tokens_in, event_id % 499 AS tokens_out, event_id % 50 = 0 AS refused, event_id % 4 AS tool_calls FROM events
), accesses AS (
  SELECT event_id AS id, ts, [json_extract_string(props, '$.k')::BIGINT, json_extract_string(props, '$.k')::BIGINT + 1] AS memory_ids, user_id % 5 AS channel_id, user_id FROM events
), entities AS (
  SELECT entity_id, name, entity_type, k % 9 + 1 AS mentions, TIMESTAMP '{NOW}' - to_days((k % 60)::INT) AS last_accessed FROM (
    SELECT 'n:' || n_nationkey AS entity_id, n_name AS name, 'nation' AS entity_type, n_nationkey::BIGINT AS k FROM nation
    UNION ALL SELECT 'r:' || r_regionkey, r_name, 'region', r_regionkey::BIGINT FROM region
    UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier', s_suppkey::BIGINT FROM supplier
    UNION ALL SELECT 'p:' || p_partkey, p_name, 'part', p_partkey::BIGINT FROM part)
), relations AS (
  SELECT 'n:' || n_nationkey AS source_id, 'r:' || n_regionkey AS target_id, 'part_of' AS relation_type, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'located_in', 0.8::DOUBLE FROM supplier
  UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, 'supplies', least(1.0::DOUBLE, count(*) / 20.0::DOUBLE) FROM lineitem GROUP BY l_suppkey, l_partkey
)
"""
