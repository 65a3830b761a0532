"""Queries of aggregates and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.plans.registry import query
from tidepool.sources import tables

USAGE = "count(*) AS calls, round(avg(latency_ms), 6) AS latency, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out"


def usage(df, key):
    return df.groupBy(key).agg(F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 6).alias("latency"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


@query("A01_usage_per_model", f"SELECT model, {USAGE} FROM interactions GROUP BY model")
def usage_per_model(spark, sf):
    return usage(tables.interactions(spark, sf), "model")


@query("A02_usage_per_tier", f"SELECT tier, {USAGE} FROM interactions GROUP BY tier")
def usage_per_tier(spark, sf):
    return usage(tables.interactions(spark, sf), "tier")


@query("A03_top_reasons", "SELECT reason, count(*) AS n FROM interactions GROUP BY reason ORDER BY n DESC, reason LIMIT 10")
def top_reasons(spark, sf):
    return tables.interactions(spark, sf).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@query("A04_last_day_totals", "SELECT count(*) AS calls, coalesce(sum(CASE WHEN refused THEN 1 ELSE 0 END), 0)::BIGINT AS refused, round(avg(latency_ms), 6) AS latency FROM interactions WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY")
def last_day_totals(spark, sf):
    rows = tables.interactions(spark, sf).where("ts >= timestamp '2024-01-30' - interval 1 day")
    return rows.agg(F.count("*").alias("calls"), F.count_if("refused").alias("refused"), F.round(F.avg("latency_ms"), 6).alias("latency"))


@query("A05_hot_memories", "WITH used AS (SELECT unnest(memory_ids) AS memory_id, channel_id FROM accesses) SELECT memory_id, count(*) AS accesses, count(DISTINCT channel_id) AS channels FROM used GROUP BY memory_id ORDER BY accesses DESC, memory_id LIMIT 20")
def hot_memories(spark, sf):
    used = tables.accesses(spark, sf).select(F.explode("memory_ids").alias("memory_id"), "channel_id")
    return used.groupBy("memory_id").agg(F.count("*").alias("accesses"), F.count_distinct("channel_id").alias("channels")).orderBy(F.desc("accesses"), "memory_id").limit(20)


@query("A06_distinct_objects", "SELECT tier, to_json(list_sort(list(DISTINCT {'model': model, 'calls': tool_calls}) FILTER (tool_calls > 1)))::VARCHAR AS objects FROM interactions GROUP BY tier")
def distinct_objects(spark, sf):
    rows = tables.interactions(spark, sf).where("tool_calls > 1")
    return rows.groupBy("tier").agg(F.to_json(F.sort_array(F.collect_set(F.struct("model", F.col("tool_calls").alias("calls"))))).alias("objects"))


@query("A07_messages_per_day", "SELECT ts::DATE AS day, count(*) AS n FROM messages GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def messages_per_day(spark, sf):
    return tables.messages(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(10)


@query("A08_length_histogram", "SELECT CASE WHEN length(content) < 50 THEN '0-50' WHEN length(content) < 200 THEN '50-200' WHEN length(content) < 500 THEN '200-500' WHEN length(content) < 1000 THEN '500-1000' ELSE '1000+' END AS bucket, count(*) AS n FROM messages WHERE content IS NOT NULL GROUP BY 1")
def length_histogram(spark, sf):
    n = F.char_length("content")
    bucket = F.when(n < 50, "0-50").when(n < 200, "50-200").when(n < 500, "200-500").when(n < 1000, "500-1000").otherwise("1000+")
    return tables.messages(spark, sf).where("content IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("A09_memories_per_type", "SELECT coalesce(memory_type, 'unknown') AS memory_type, count(*) AS n FROM memories GROUP BY 1")
def memories_per_type(spark, sf):
    return tables.memories(spark, sf).groupBy(F.coalesce("memory_type", F.lit("unknown")).alias("memory_type")).agg(F.count("*").alias("n"))


@query("A10_graph_stats", "SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relations) AS relations, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM relations GROUP BY source_id)) AS mean_out_degree")
def graph_stats(spark, sf):
    relations = tables.relations(spark, sf)
    degrees = relations.groupBy("source_id").count().agg(F.sum("count").alias("relations"), F.round(F.avg("count"), 6).alias("mean_out_degree"))
    return tables.entities(spark, sf).agg(F.count("*").alias("entities")).crossJoin(degrees)  # one row each


@query("A11_degrees", "SELECT coalesce(o.id, i.id) AS id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM (SELECT source_id AS id, count(*) AS n FROM relations GROUP BY 1) o FULL JOIN (SELECT target_id AS id, count(*) AS n FROM relations GROUP BY 1) i ON o.id = i.id")
def degrees(spark, sf):
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"))))
    both = tables.relations(spark, sf).select(ends.alias("e")).select("e.*")
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum(1 - F.col("o")).alias("in_degree"))


@query("A12_relation_types", "SELECT relation_type, count(*) AS n FROM relations GROUP BY 1 ORDER BY n DESC, relation_type LIMIT 10")
def relation_types(spark, sf):
    return tables.relations(spark, sf).groupBy("relation_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation_type").limit(10)


@query("A15_exact_duplicates", "SELECT id, hash, rank > 1 AS dropped FROM (SELECT id, sha256(left(lower(trim(content)), 500)) AS hash, row_number() OVER (PARTITION BY sha256(left(lower(trim(content)), 500)) ORDER BY importance DESC, id) AS rank FROM memories WHERE content IS NOT NULL)")
def exact_duplicates(spark, sf):
    key = F.sha2(F.substring(F.lower(F.trim("content")), 1, 500), 256)
    rows = tables.memories(spark, sf).where("content IS NOT NULL").select("id", "importance", key.alias("hash"))
    rank = F.row_number().over(Window.partitionBy("hash").orderBy(F.desc("importance"), "id"))
    return rows.select("id", "hash", (rank > 1).alias("dropped"))


@query("A16_topic_groups", "SELECT topic, id, count(*) OVER (PARTITION BY topic) AS n FROM memories WHERE memory_type <> 'insight' AND created_at <= TIMESTAMP '2024-02-01' - INTERVAL 5 DAY AND repetitions >= 2 QUALIFY count(*) OVER (PARTITION BY topic) >= 2")
def topic_groups(spark, sf):
    """A row for each memory of a group, so a group of any size is no single row."""
    rows = tables.memories(spark, sf).where("memory_type <> 'insight' AND repetitions >= 2").where(F.col("created_at") <= tables.now() - F.expr("interval 5 days")).select("topic", "id")
    return rows.join(rows.groupBy("topic").agg(F.count("*").alias("n")).where("n >= 2"), "topic").select("topic", "id", "n")


@query("A18_behaviour", "SELECT conversation_id, round(avg(latency_ms), 6) AS latency, round(10 * avg((tool_calls > 0)::INT), 6) AS tool_use FROM interactions WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY GROUP BY 1")
def behaviour(spark, sf):
    rows = tables.interactions(spark, sf).where("ts >= timestamp '2024-01-30' - interval 7 days")
    return rows.groupBy("conversation_id").agg(F.round(F.avg("latency_ms"), 6).alias("latency"), F.round(10 * F.avg((F.col("tool_calls") > 0).cast("int")), 6).alias("tool_use"))


@query("A19_session_duration", "SELECT round(avg(epoch(ended_at) - epoch(started_at)), 6) AS seconds FROM sessions")
def session_duration(spark, sf):
    return tables.sessions(spark, sf).agg(F.round(F.avg(F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")), 6).alias("seconds"))


@query("A20_scalar_counts", "SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM sessions WHERE summary IS NULL) AS open")
def scalar_counts(spark, sf):
    return tables.sessions(spark, sf).agg(F.count("*").alias("sessions"), F.sum("turns").alias("messages"), F.count_if(F.col("summary").isNull()).alias("open"))


@query("A21_peak_hours", "WITH h AS (SELECT r AS hour, count(i.id) AS n FROM range(24) t(r) LEFT JOIN interactions i ON hour(i.ts) = r GROUP BY r) SELECT hour, n FROM h WHERE n > (SELECT avg(n) + 0.5 * stddev_pop(n) FROM h)")
def peak_hours(spark, sf):
    counts = tables.interactions(spark, sf).groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    day = spark.range(24).select(F.col("id").alias("hour")).join(counts, "hour", "left").fillna(0, "n")
    limit = day.agg((F.avg("n") + 0.5 * F.stddev_pop("n")).alias("most"))
    return day.crossJoin(limit).where("n > most").select("hour", "n")  # one row of limits


@query("A23_histogram", "SELECT b::DOUBLE AS bound, count(*) FILTER (latency_ms <= b) AS n FROM interactions, (VALUES (1.0), (5.0), (10.0), (50.0), (100.0), (500.0)) v(b) GROUP BY b")
def histogram(spark, sf):
    found = tables.interactions(spark, sf).agg(*[F.count_if(F.col("latency_ms") <= b).alias(f"b{k}") for k, b in enumerate((1.0, 5.0, 10.0, 50.0, 100.0, 500.0))])
    return found.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bound"), F.col(f"b{k}").alias("n")) for k, b in enumerate((1.0, 5.0, 10.0, 50.0, 100.0, 500.0))])).alias("x")).select("x.*")


@query("A24_tool_metrics", "SELECT model AS tool, count(*) AS calls, count(*) FILTER (NOT refused) AS success, count(*) FILTER (refused) AS errors, round(avg(latency_ms), 6) AS latency, max(id) FILTER (refused) AS last_error FROM interactions GROUP BY model")
def tool_metrics(spark, sf):
    c = F.col
    return tables.interactions(spark, sf).groupBy(c("model").alias("tool")).agg(F.count("*").alias("calls"), F.count_if(~c("refused")).alias("success"), F.count_if("refused").alias("errors"), F.round(F.avg("latency_ms"), 6).alias("latency"), F.max(F.when(c("refused"), c("id"))).alias("last_error"))


@query("A25_entities_per_domain", "SELECT split_part(entity_id, ':', 1) AS domain, count(*) AS n FROM entities GROUP BY 1")
def entities_per_domain(spark, sf):
    return tables.entities(spark, sf).groupBy(F.substring_index("entity_id", ":", 1).alias("domain")).agg(F.count("*").alias("n"))


@query("A29_single_mentions", "SELECT round(100 * avg((mentions = 1)::INT), 6) AS percent, avg((mentions = 1)::INT) < 0.3 AS passed FROM entities")
def single_mentions(spark, sf):
    share = F.avg((F.col("mentions") == 1).cast("int"))
    return tables.entities(spark, sf).agg(F.round(100 * share, 6).alias("percent"), (share < 0.3).alias("passed"))


@query("A31_meta_stats", "WITH used AS (SELECT unnest(memory_ids) AS m FROM accesses) SELECT (SELECT count(DISTINCT m) FROM used) AS memories, (SELECT count(*) FROM accesses) AS patterns, (SELECT count(DISTINCT channel_id) FROM accesses) AS channels")
def meta_stats(spark, sf):
    rows = tables.accesses(spark, sf)
    used = rows.select(F.explode("memory_ids").alias("m")).agg(F.count_distinct("m").alias("memories"))
    return used.crossJoin(rows.agg(F.count("*").alias("patterns"), F.count_distinct("channel_id").alias("channels")))  # one row each


@query("A32_turn_count", "SELECT session_id, count(*) // 2 AS turns, max(ts) AS last_activity FROM messages GROUP BY session_id")
def turn_count(spark, sf):
    return tables.messages(spark, sf).groupBy("session_id").agg(F.floor(F.count("*") / 2).cast("long").alias("turns"), F.max("ts").alias("last_activity"))


@query("A33_promoted_sessions", "SELECT topic, max(importance) AS best FROM memories GROUP BY topic HAVING max(importance) >= 0.6")
def promoted_sessions(spark, sf):
    return tables.memories(spark, sf).groupBy("topic").agg(F.max("importance").alias("best")).where("best >= 0.6")


@query("A34_task_summary", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def task_summary(spark, sf):
    return tables.read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("A37_adaptive_timeout", "SELECT id, round(least(120.0, greatest(5.0, 3 * avg(latency_ms) OVER (PARTITION BY conversation_id ORDER BY ts, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10 * CASE WHEN tool_calls > 2 THEN 2.0 WHEN tool_calls > 0 THEN 1.5 ELSE 1.0 END)), 6) AS seconds FROM interactions")
def adaptive_timeout(spark, sf):
    last = F.avg("latency_ms").over(Window.partitionBy("conversation_id").orderBy("ts", "id").rowsBetween(-9, 0))
    factor = F.when(F.col("tool_calls") > 2, 2.0).when(F.col("tool_calls") > 0, 1.5).otherwise(1.0)
    return tables.interactions(spark, sf).select("id", F.round(F.least(F.lit(120.0), F.greatest(F.lit(5.0), 3 * last / 10 * factor)), 6).alias("seconds"))


@query("A22_counters_and_gauges", "SELECT model, sum(tokens_in)::BIGINT AS counter, arg_max(latency_ms, (ts, id)) AS gauge FROM interactions GROUP BY model")
def counters_and_gauges(spark, sf):
    return tables.interactions(spark, sf).groupBy("model").agg(F.sum("tokens_in").alias("counter"), F.max_by("latency_ms", F.struct("ts", "id")).alias("gauge"))


ORACLE_A27 = "WITH r AS (SELECT id, CASE WHEN importance >= 0.55 THEN 'importance' WHEN repetitions >= 2 AND importance >= 0.35 THEN 'repetitions' ELSE 'rejected' END AS reason FROM memories) SELECT reason, count(*) AS n, array_to_string(list_sort(list(id))[1:5], ',') AS samples FROM r GROUP BY reason"


@query("A27_migration_report", ORACLE_A27)
def migration_report(spark, sf):
    reason = F.when(F.col("importance") >= 0.55, "importance").when((F.col("repetitions") >= 2) & (F.col("importance") >= 0.35), "repetitions").otherwise("rejected")
    rows = tables.memories(spark, sf).select("id", reason.alias("reason"))
    counts = rows.groupBy("reason").agg(F.count("*").alias("n"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("reason").orderBy("id"))).where("k <= 5").groupBy("reason").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("samples"))
    return counts.join(first, "reason")


@query("S45_promotion_report", ORACLE_A27)
def promotion_report(spark, sf):
    """What moving an older store over would keep, and why: by document, counted by reason, with five of each."""
    return migration_report(spark, sf)
