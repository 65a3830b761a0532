"""Queries of maintenance: snapshots, retention, consolidation, clean-up pipelines and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import filters, selection, snapshots
from tidepool.plans.registry import query
from tidepool.plans.scoring import DECAYED, with_decay
from tidepool.sources import tables


@query("S05_pending_migrations", "SELECT r_name AS filename FROM region WHERE r_regionkey > 1 ORDER BY 1")
def pending_migrations(spark, sf):
    known = tables.read(spark, sf, "region").select(F.col("r_name").alias("filename"), "r_regionkey")
    return known.join(known.where("r_regionkey <= 1"), "filename", "left_anti").select("filename")


@query("S11_newest", "SELECT id, created_at FROM memories ORDER BY created_at DESC, id LIMIT 25")
def newest(spark, sf):
    return tables.memories(spark, sf).orderBy(F.desc("created_at"), "id").limit(25).select("id", "created_at")


@query("S12_point_lookup", "SELECT id, memory_type, importance FROM memories WHERE id = 42")
def point_lookup(spark, sf):
    return tables.memories(spark, sf).where("id = 42").select("id", "memory_type", "importance")


@query("S15_update", "SELECT id, CASE WHEN id % 10 = 0 THEN 0.9 ELSE importance END::DOUBLE AS importance, access_count FROM memories")
def update(spark, sf):
    rows = tables.memories(spark, sf).select("id", "importance", "access_count")
    changes = rows.where("id % 10 = 0").select("id", F.lit(0.9).alias("importance"), F.lit(-1).alias("unknown"))
    return snapshots.update(rows, changes, "id", ["importance"])


@query("S18_delete", "SELECT id FROM memories WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def delete(spark, sf):
    gone = tables.read(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return snapshots.delete(tables.memories(spark, sf), gone, "id").select("id")


@query("S19_row_count", "SELECT count(*) AS n FROM memories")
def row_count(spark, sf):
    return tables.memories(spark, sf).agg(F.count("*").alias("n"))


@query("S22_append_messages", "SELECT session_id, turn_id, role FROM messages UNION ALL SELECT session_id, max(turn_id) + 1, 'user' FROM messages WHERE session_id % 5 = 0 GROUP BY 1")
def append_messages(spark, sf):
    rows = tables.messages(spark, sf).select("session_id", "turn_id", "role")
    new = rows.where("session_id % 5 = 0").select("session_id").distinct().withColumn("role", F.lit("user"))
    return rows.unionByName(snapshots.numbered(rows, new, "session_id", "turn_id", [F.asc("role")]))


@query("S24_archive", "SELECT session_id, turn_id, session_id IN (SELECT session_id FROM sessions WHERE ended_at < TIMESTAMP '2024-01-03') AS archived FROM messages")
def archive(spark, sf):
    old = tables.sessions(spark, sf).where("ended_at < timestamp '2024-01-03'").select("session_id", F.lit(True).alias("archived"))
    return tables.messages(spark, sf).join(old, "session_id", "left").select("session_id", "turn_id", F.coalesce("archived", F.lit(False)).alias("archived"))


@query("S44_union_scan", "SELECT * FROM (SELECT 'memory' AS source, id::VARCHAR AS id, created_at AS ts FROM memories UNION ALL SELECT 'message', session_id || ':' || turn_id, ts FROM messages WHERE length(content) > 50) ORDER BY ts DESC, source, id LIMIT 100")
def union_scan(spark, sf):
    a = tables.memories(spark, sf).select(F.lit("memory").alias("source"), F.col("id").cast("string").alias("id"), F.col("created_at").alias("ts"))
    b = tables.messages(spark, sf).where(F.char_length("content") > 50).select(F.lit("message").alias("source"), F.concat_ws(":", "session_id", "turn_id").alias("id"), "ts")
    return a.unionByName(b).orderBy(F.desc("ts"), "source", "id").limit(100)


@query("S47_log_lines", "SELECT id, model AS module, floor(latency_ms)::BIGINT::VARCHAR AS ms FROM interactions")
def log_lines(spark, sf):
    line = F.concat(F.lit("2024-01-01 INFO [req|"), "model", F.lit("] done | ms="), F.floor("latency_ms").cast("string"))
    rows = tables.interactions(spark, sf).select("id", line.alias("line"))
    return rows.select("id", F.regexp_extract("line", r"\[[^|]*\|([^\]]*)\]", 1).alias("module"), F.str_to_map(F.regexp_extract("line", r"\| (\S+=\S+)$", 1), F.lit(" "), F.lit("="))["ms"].alias("ms"))


@query("S48_exposition", "SELECT string_agg('calls{model=\"' || model || '\"} ' || n, chr(10) ORDER BY model) AS text FROM (SELECT model, count(*) AS n FROM interactions GROUP BY model)")
def exposition(spark, sf):
    rows = tables.interactions(spark, sf).groupBy("model").count().select(F.format_string('calls{model="%s"} %d', "model", "count").alias("line"))
    return rows.agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))


@query("S52_retention", "SELECT day, rank() OVER (ORDER BY day DESC) <= 7 AS kept FROM (SELECT DISTINCT ts::DATE AS day FROM interactions)")
def retention(spark, sf):
    days = tables.interactions(spark, sf).select(F.to_date("ts").alias("day")).distinct()
    return days.select("day", (F.rank().over(Window.orderBy(F.desc("day"))) <= 7).alias("kept"))


@query("S53_status", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages")
def status(spark, sf):
    one = lambda name: tables.read(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("documents").unionByName(one("events")).unionByName(one("pages"))


@query("F17_fade_delete", f"SELECT id FROM memories WHERE {DECAYED} < 0.03 AND repetitions < 2 AND access_count < 3")
def fade_delete(spark, sf):
    return with_decay(tables.memories(spark, sf)).where("decayed < 0.03 AND repetitions < 2 AND access_count < 3").select("id")


@query("F21_decay_cleanup", f"SELECT id FROM memories WHERE {DECAYED} < 0.1 OR (importance < 0.1 AND access_count <= 1)")
def decay_cleanup(spark, sf):
    return with_decay(tables.memories(spark, sf)).where("(decayed IS NOT NULL AND decayed < 0.1) OR (importance < 0.1 AND access_count <= 1)").select("id")


@query("F22_age_retention", "SELECT count(*) AS kept FROM interactions WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY")
def age_retention(spark, sf):
    return tables.interactions(spark, sf).where(F.col("ts") >= tables.now() - F.expr("interval 20 days")).agg(F.count("*").alias("kept"))


@query("F23_stale_entities", "SELECT entity_id FROM entities WHERE mentions < 3 AND last_accessed < TIMESTAMP '2024-02-01' - INTERVAL 30 DAY")
def stale_entities(spark, sf):
    return tables.entities(spark, sf).where("mentions < 3").where(F.col("last_accessed") < tables.now() - F.expr("interval 30 days")).select("entity_id")


@query("F24_weak_relations", "SELECT source_id, target_id FROM relations WHERE weight < 0.1")
def weak_relations(spark, sf):
    return tables.relations(spark, sf).where("weight < 0.1").select("source_id", "target_id")


@query("P02_consolidate", f"SELECT id, round({DECAYED}, 6) AS importance, (preserved OR repetitions >= 3) AS preserved FROM memories WHERE preserved OR repetitions >= 3 OR NOT ({DECAYED} < 0.03 AND repetitions < 2 AND access_count < 3)")
def consolidate(spark, sf):
    rows = with_decay(tables.memories(spark, sf)).withColumn("preserved", F.expr("preserved OR repetitions >= 3"))
    kept = rows.where("preserved OR NOT (decayed < 0.03 AND repetitions < 2 AND access_count < 3)")
    return kept.select("id", F.round("decayed", 6).alias("importance"), "preserved")


@query("P03_eviction", f"SELECT id FROM memories WHERE {DECAYED} < 0.1 AND repetitions < 3 AND access_count < 3 AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 168 HOUR ORDER BY id LIMIT 200")
def eviction(spark, sf):
    rows = with_decay(tables.memories(spark, sf)).where("decayed < 0.1 AND repetitions < 3 AND access_count < 3").where(F.col("created_at") < tables.now() - F.expr("interval 168 hours"))
    return rows.orderBy("id").limit(200).select("id")


@query("P06_full_gc", f"""
WITH kept AS (SELECT * FROM memories WHERE content IS NOT NULL AND length(content) <= 50000 QUALIFY row_number() OVER (PARTITION BY sha256(left(lower(trim(content)), 500)) ORDER BY importance DESC, id) = 1)
SELECT id FROM kept WHERE NOT ({DECAYED} < 0.1 OR (importance < 0.1 AND access_count <= 1))""")  # fmt: skip
def full_gc(spark, sf):
    rows = tables.memories(spark, sf).where(F.char_length("content") <= 50_000).withColumn("hash", F.sha2(F.substring(F.lower(F.trim("content")), 1, 500), 256)).drop("content")
    rows = selection.best_per_group(rows, ["hash"], [F.desc("importance"), F.asc("id")])
    return with_decay(rows).where("NOT (decayed < 0.1 OR (importance < 0.1 AND access_count <= 1))").select("id")


@query("P07_long_turn_removal", """
WITH long AS (SELECT session_id, turn_id FROM messages WHERE role = 'assistant' AND length(content) > 400),
gone AS (SELECT * FROM long UNION SELECT session_id, turn_id - 1 FROM long)
SELECT session_id, turn_id FROM messages EXCEPT SELECT * FROM gone""")  # fmt: skip
def long_turn_removal(spark, sf):
    rows = tables.messages(spark, sf)
    long = rows.where("role = 'assistant'").where(filters.long_or_code(F.col("content"), 400))
    gone = long.select("session_id", F.explode(F.array("turn_id", F.col("turn_id") - 1)).alias("turn_id"))
    return rows.join(gone, ["session_id", "turn_id"], "left_anti").select("session_id", "turn_id")


@query("P13_expired_sessions", "SELECT session_id, coalesce(summary, 'turns: ' || turns) AS summary FROM sessions WHERE ended_at < TIMESTAMP '2024-01-04'")
def expired_sessions(spark, sf):
    rows = tables.sessions(spark, sf).where("ended_at < timestamp '2024-01-04'")
    return rows.select("session_id", F.coalesce("summary", F.concat(F.lit("turns: "), F.col("turns").cast("string"))).alias("summary"))


@query("P15_interaction_report", "SELECT model, tier, count(*) AS calls, round(avg(latency_ms), 6) AS latency, count(*) FILTER (refused) AS refused FROM interactions GROUP BY 1, 2")
def interaction_report(spark, sf):
    return tables.interactions(spark, sf).groupBy("model", "tier").agg(F.count("*").alias("calls"), F.round(F.avg("latency_ms"), 6).alias("latency"), F.count_if("refused").alias("refused"))


@query("W06_greedy_budget")
def greedy_budget(spark, sf):
    rows = tables.memories(spark, sf).where("importance >= 0.5").withColumn("query", F.col("id") % 10).withColumn("size", F.char_length("content"))
    best = selection.newest(rows, ["query"], [F.desc("importance"), F.asc("id")], 40)
    return selection.greedy_budget(best, ["query"], "id", "importance", "size", "topic", 8000)
