"""Queries over messages, sessions and memories: filters, pairings, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import filters, selection
from tidepool.plans.registry import query
from tidepool.sources import tables


@query("F01_filter_dsl", "SELECT id FROM memories WHERE importance >= 0.3 AND importance < 0.8 AND (memory_type = 'fact' OR (access_count <> 2 AND repetitions > 2))")
def filter_dsl(spark, sf):
    rule = {"importance": {"$gte": 0.3, "$lt": 0.8}, "$or": [{"memory_type": "fact"}, {"$and": [{"access_count": {"$ne": 2}}, {"repetitions": {"$gt": 2}}]}]}
    return tables.memories(spark, sf).where(filters.compile_filter(rule)).select("id")


@query("F02_projection_defaults", "SELECT id, coalesce(CASE WHEN id % 5 > 0 THEN memory_type END, 'insight') AS memory_type, coalesce(CASE WHEN id % 3 > 0 THEN importance END, 0.5) AS importance FROM memories")
def projection_defaults(spark, sf):
    keep = lambda n, c: F.when(F.col("id") % n > 0, F.col(c))
    return tables.memories(spark, sf).select("id", F.coalesce(keep(5, "memory_type"), F.lit("insight")).alias("memory_type"), F.coalesce(keep(3, "importance"), F.lit(0.5)).alias("importance"))


@query("F04_date_range", "SELECT session_id, turn_id FROM messages WHERE ts >= DATE '2024-01-01' AND ts < DATE '2024-01-01' + 1 ORDER BY ts, session_id, turn_id LIMIT 40")
def date_range(spark, sf):
    rows = tables.messages(spark, sf).where((F.col("ts") >= F.lit("2024-01-01").cast("date")) & (F.col("ts") < F.date_add(F.lit("2024-01-01").cast("date"), 1)))
    return rows.orderBy("ts", "session_id", "turn_id").limit(40).select("session_id", "turn_id")


@query("F05_topic_search", "SELECT id FROM memories WHERE topic = 'src3' OR content ILIKE '%license%'")
def topic_search(spark, sf):
    return tables.memories(spark, sf).where(F.array_contains(F.array("topic"), "src3") | F.col("content").ilike("%license%")).select("id")


@query("F07_name_search", "SELECT entity_id, mentions FROM entities WHERE name ILIKE '%an%' ORDER BY mentions DESC, entity_id LIMIT 20")
def name_search(spark, sf):
    return tables.entities(spark, sf).where(F.col("name").ilike("%an%")).orderBy(F.desc("mentions"), "entity_id").limit(20).select("entity_id", "mentions")


@query("F08_many_names", "SELECT DISTINCT entity_id FROM entities JOIN (VALUES ('china'), ('asia'), ('green')) q(w) ON contains(lower(name), w)")
def many_names(spark, sf):
    words = F.array(*map(F.lit, ("china", "asia", "green")))
    return tables.entities(spark, sf).where(F.exists(words, lambda w: F.contains(F.lower("name"), w))).select("entity_id").distinct()


@query("F09_by_type", "SELECT entity_id, mentions FROM entities WHERE entity_type = 'nation'")
def by_type(spark, sf):
    return tables.entities(spark, sf).where("entity_type = 'nation'").select("entity_id", "mentions")


@query("F10_existence", "SELECT session_id FROM sessions s WHERE EXISTS (SELECT 1 FROM messages m WHERE m.session_id = s.session_id AND m.role = 'system')")
def existence(spark, sf):
    system = tables.messages(spark, sf).where("role = 'system'")
    return tables.sessions(spark, sf).join(system, "session_id", "left_semi").select("session_id")


@query("F14_oversize", "SELECT doc_id, CASE WHEN length(text) > 5000 THEN 'oversize' ELSE 'image' END AS reason FROM documents WHERE length(text) > 5000 OR contains(text, 'data:image') OR contains(text, 'base64,')")
def oversize(spark, sf):
    long, image = F.char_length("text") > 5000, F.contains("text", F.lit("data:image")) | F.contains("text", F.lit("base64,"))
    return tables.read(spark, sf, "documents").where(long | image).select("doc_id", F.when(long, "oversize").otherwise("image").alias("reason"))


@query("F16_promotion", "SELECT id, CASE WHEN importance >= 0.55 THEN 'importance:' || printf('%.2f', importance) WHEN repetitions >= 2 AND importance >= 0.35 THEN 'repetitions:' || repetitions || ',importance:' || printf('%.2f', importance) ELSE 'low_importance:' || printf('%.2f', importance) END AS reason FROM memories")
def promotion(spark, sf):
    return tables.memories(spark, sf).select("id", filters.promotion_reason(F.col("importance"), F.col("repetitions")).alias("reason"))


@query("F18_preserve", "SELECT id FROM memories WHERE repetitions >= 3 AND NOT preserved")
def preserve(spark, sf):
    return tables.memories(spark, sf).where("repetitions >= 3 AND NOT preserved").select("id")


@query("F20_reassess", "SELECT id, access_count FROM memories WHERE access_count >= 3 AND created_at <= TIMESTAMP '2024-02-01' - INTERVAL 168 HOUR ORDER BY access_count DESC, id LIMIT 50")
def reassess(spark, sf):
    rows = tables.memories(spark, sf).where("access_count >= 3").where(F.col("created_at") <= tables.now() - F.expr("interval 168 hours"))
    return rows.orderBy(F.desc("access_count"), "id").limit(50).select("id", "access_count")


@query("F25_long_turns", "SELECT session_id, turn_id FROM messages WHERE length(content) > 400 OR (length(content) - length(replace(content, '```', ''))) // 3 >= 8")
def long_turns(spark, sf):
    return tables.messages(spark, sf).where(filters.long_or_code(F.col("content"), 400)).select("session_id", "turn_id")


@query("F27_expired", "SELECT session_id FROM sessions WHERE ended_at < TIMESTAMP '2024-02-01' - INTERVAL 2 DAY AND summary IS NULL ORDER BY ended_at, session_id LIMIT 20")
def expired(spark, sf):
    return tables.sessions(spark, sf).where("summary IS NULL").where(F.col("ended_at") < tables.now() - F.expr("interval 2 days")).orderBy("ended_at", "session_id").limit(20).select("session_id")


@query("F32_cron", "SELECT id FROM interactions WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 17 AND dayofweek(ts) BETWEEN 1 AND 5")
def cron(spark, sf):
    return tables.interactions(spark, sf).where(filters.cron("*/15 8-17 * * 1-5", F.col("ts"))).select("id")


@query("F36_interaction_log", "SELECT id, ts FROM interactions WHERE conversation_id = 5 ORDER BY ts DESC, id LIMIT 30")
def interaction_log(spark, sf):
    return tables.interactions(spark, sf).where("conversation_id = 5").orderBy(F.desc("ts"), "id").limit(30).select("id", "ts")


@query("F39_code_search", "WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), c AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)) SELECT doc_id, n::INT AS n, line, before, after FROM c WHERE regexp_matches(line, '[Ll]icen')")
def code_search(spark, sf):
    lines = tables.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return selection.with_context(lines, "doc_id", "n", "line").where(F.col("line").rlike("[Ll]icen")).select("doc_id", "n", "line", "before", "after")


@query("J01_turn_pairs", "SELECT a.session_id, a.turn_id FROM messages a JOIN messages b ON a.session_id = b.session_id AND a.turn_id = b.turn_id - 1 AND a.role = 'user' AND b.role = 'assistant'")
def turn_pairs(spark, sf):
    m = tables.messages(spark, sf)
    a, b = m.where("role = 'user'").select("session_id", "turn_id"), m.where("role = 'assistant'").select("session_id", (F.col("turn_id") - 1).alias("turn_id"))
    return a.join(b, ["session_id", "turn_id"])


@query("J02_orphan_turns", "SELECT a.session_id, a.turn_id FROM messages a WHERE NOT EXISTS (SELECT 1 FROM messages b WHERE a.session_id = b.session_id AND ((a.role = 'user' AND b.role = 'assistant' AND b.turn_id = a.turn_id + 1) OR (a.role = 'assistant' AND b.role = 'user' AND b.turn_id = a.turn_id - 1)))")
def orphan_turns(spark, sf):
    # a neighbour in the same session decides, so one window takes the place of an anti-join with OR
    w = Window.partitionBy("session_id").orderBy("turn_id")
    beside = lambda f, step: F.when(f("turn_id").over(w) == F.col("turn_id") + step, f("role").over(w))
    rows = tables.messages(spark, sf).select("session_id", "turn_id", "role", beside(F.lead, 1).alias("after"), beside(F.lag, -1).alias("before"))
    paired = ((F.col("role") == "user") & F.col("after").eqNullSafe("assistant")) | ((F.col("role") == "assistant") & F.col("before").eqNullSafe("user"))
    return rows.where(~F.coalesce(paired, F.lit(False))).select("session_id", "turn_id")


@query("J18_session_with_messages", "SELECT s.session_id, s.turns, s.summary, row_number() OVER (PARTITION BY session_id ORDER BY m.turn_id) AS place, m.role FROM sessions s JOIN messages m USING (session_id)")
def session_with_messages(spark, sf):
    """A session's header beside each of its messages, with their places: rows, not an array, so a session may be of any size."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_id")).cast("long")
    rows = tables.messages(spark, sf).select("session_id", "role", place.alias("place"))
    return tables.sessions(spark, sf).select("session_id", "turns", "summary").join(rows, "session_id")


@query("J19_channel_mentions", "WITH used AS (SELECT unnest(memory_ids) AS id, channel_id FROM accesses), c AS (SELECT id, count(DISTINCT channel_id) AS n FROM used GROUP BY id) SELECT m.id, coalesce(c.n, 0) AS channels FROM memories m LEFT JOIN c USING (id)")
def channel_mentions(spark, sf):
    used = tables.accesses(spark, sf).select(F.explode("memory_ids").alias("id"), "channel_id").groupBy("id").agg(F.count_distinct("channel_id").alias("n"))
    return tables.memories(spark, sf).select("id").join(used, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("channels"))


@query("J21_cross_store", "SELECT 'memory' AS store, id::VARCHAR AS key, importance AS score FROM memories WHERE content ILIKE '%license%' UNION ALL SELECT 'session', session_id::VARCHAR, 0.5 FROM sessions WHERE summary ILIKE '%the%'")
def cross_store(spark, sf):
    a = tables.memories(spark, sf).where(F.col("content").ilike("%license%")).select(F.lit("memory").alias("store"), F.col("id").cast("string").alias("key"), F.col("importance").alias("score"))
    b = tables.sessions(spark, sf).where(F.col("summary").ilike("%the%")).select(F.lit("session").alias("store"), F.col("session_id").cast("string").alias("key"), F.lit(0.5).alias("score"))
    return a.unionByName(b)


@query("W01_next_turn", "SELECT session_id, turn_id + 1 + (SELECT 0) AS next FROM (SELECT session_id, coalesce(max(turn_id), -1) AS turn_id FROM messages GROUP BY 1)")
def next_turn(spark, sf):
    return tables.messages(spark, sf).groupBy("session_id").agg((F.coalesce(F.max("turn_id"), F.lit(-1)) + 1).alias("next"))


@query("W03_protected_turns", "SELECT session_id, turn_id, turn_id > max(turn_id) OVER (PARTITION BY session_id) - 4 AS protected FROM messages")
def protected_turns(spark, sf):
    last = F.max("turn_id").over(Window.partitionBy("session_id"))
    return tables.messages(spark, sf).select("session_id", "turn_id", (F.col("turn_id") > last - 4).alias("protected"))


@query("W04_first_per_key", "SELECT DISTINCT ON (target_id) target_id, source_id, weight FROM relations ORDER BY target_id, weight DESC, source_id")
def first_per_key(spark, sf):
    return selection.best_per_group(tables.relations(spark, sf), ["target_id"], [F.desc("weight"), F.asc("source_id")]).select("target_id", "source_id", "weight")


@query("W07_running_cutoff", "WITH r AS (SELECT session_id, turn_id, sum(length(content)) OVER (PARTITION BY session_id ORDER BY turn_id) AS total FROM messages) SELECT session_id, turn_id, total::BIGINT AS total FROM r WHERE total <= 600")
def running_cutoff(spark, sf):
    return selection.within_budget(tables.messages(spark, sf), ["session_id"], ["turn_id"], F.char_length("content"), 600).select("session_id", "turn_id", "total")


@query("W08_progressive_context", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) AS k FROM messages) SELECT session_id, string_agg(role || ': ' || CASE WHEN k <= 4 THEN content WHEN role = 'user' THEN left(content, 50) ELSE left(content, 30) END, chr(10) ORDER BY turn_id) AS context FROM r GROUP BY session_id")
def progressive_context(spark, sf):
    """Each session's context: the last four messages whole, older ones cut, in lines by turn."""
    k = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_id")))
    text = F.when(F.col("k") <= 4, F.col("content")).when(F.col("role") == "user", F.substring("content", 1, 50)).otherwise(F.substring("content", 1, 30))
    rows = tables.messages(spark, sf).withColumn("k", k).select("session_id", "turn_id", F.concat("role", F.lit(": "), text).alias("line"))
    return rows.groupBy("session_id").agg(F.expr(r"listagg(line, '\n') WITHIN GROUP (ORDER BY turn_id NULLS LAST, line)").alias("context"))


@query("W09_most_recent", "SELECT model, id FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, id DESC) AS k FROM interactions) WHERE k <= 5")
def most_recent(spark, sf):
    return selection.newest(tables.interactions(spark, sf), ["model"], [F.desc("ts"), F.desc("id")], 5).select("model", "id")


@query("W10_bounded_buffer", "SELECT user_id, least(count(*), 40) AS kept, greatest(count(*) - 40, 0) AS dropped FROM accesses GROUP BY user_id")
def bounded_buffer(spark, sf):
    n = F.count("*")
    return tables.accesses(spark, sf).groupBy("user_id").agg(F.least(n, F.lit(40)).alias("kept"), F.greatest(n - 40, F.lit(0)).alias("dropped"))


@query("W13_previous_channel", "SELECT a.user_id, arg_max(a.channel_id, (a.ts, a.id)) AS channel FROM accesses a GROUP BY 1")
def previous_channel(spark, sf):
    return tables.accesses(spark, sf).groupBy("user_id").agg(F.max_by("channel_id", F.struct("ts", "id")).alias("channel"))


@query("W15_since_last_session", "SELECT epoch(TIMESTAMP '2024-02-01') - epoch(max(ended_at)) AS seconds FROM sessions")
def since_last_session(spark, sf):
    return tables.sessions(spark, sf).agg((F.unix_timestamp(tables.now()) - F.unix_timestamp(F.max("ended_at"))).cast("double").alias("seconds"))


@query("W16_confidence_decay", "SELECT id, round(importance * 0.9, 2) AS confidence FROM memories WHERE round(importance * 0.9, 2) >= 0.3")
def confidence_decay(spark, sf):
    return tables.memories(spark, sf).select("id", F.round(F.col("importance") * 0.9, 2).alias("confidence")).where("confidence >= 0.3")


@query("L06_chronological", "SELECT id, row_number() OVER (ORDER BY coalesce(created_at, TIMESTAMP '1970-01-01') DESC, id) AS place FROM (SELECT * FROM memories ORDER BY importance DESC, id LIMIT 50)")
def chronological(spark, sf):
    hits = tables.memories(spark, sf).orderBy(F.desc("importance"), "id").limit(50)
    w = Window.orderBy(F.desc(F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp"))), "id")
    return hits.select("id", F.row_number().over(w).cast("long").alias("place"))


@query("U01_bag_union", "SELECT 'memory' AS store, id FROM memories UNION ALL SELECT 'session', session_id FROM sessions")
def bag_union(spark, sf):
    return tables.memories(spark, sf).select(F.lit("memory").alias("store"), "id").unionByName(tables.sessions(spark, sf).select(F.lit("session").alias("store"), F.col("session_id").alias("id")))


@query("U03_relation_dedup", "SELECT DISTINCT source_id, relation_type, target_id FROM relations")
def relation_dedup(spark, sf):
    return tables.relations(spark, sf).dropDuplicates(["source_id", "relation_type", "target_id"]).select("source_id", "relation_type", "target_id")


@query("U04_survivors", "SELECT id FROM memories EXCEPT SELECT id FROM memories WHERE importance < 0.2")
def survivors(spark, sf):
    m = tables.memories(spark, sf)
    return m.select("id").join(m.where("importance < 0.2").select("id"), "id", "left_anti")


@query("U06_unordered_pairs", "SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM relations")
def unordered_pairs(spark, sf):
    return tables.relations(spark, sf).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
