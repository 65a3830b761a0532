"""Queries of stores, assembled contexts, and rules on words and dates that SQL states less well."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.functions import dates, rules, scores, texts
from tidepool.operators import graph, selection, similarity, snapshots, web
from tidepool.plans.graph import EDGES, levels, reached
from tidepool.plans.registry import query
from tidepool.plans.rules import quoted
from tidepool.plans.scoring import COSINE, DECAYED, with_decay
from tidepool.sources import tables


@query("S10_projection_scan", "SELECT id, memory_type FROM memories ORDER BY id LIMIT 50")
def projection_scan(spark, sf):
    return tables.memories(spark, sf).select("id", "memory_type").orderBy("id").limit(50)


@query("S13_insert", "SELECT id, memory_type, importance FROM memories UNION ALL SELECT -1, 'insight', 0.5")
def insert(spark, sf):
    rows = tables.memories(spark, sf).select("id", "memory_type", "importance")
    new = spark.createDataFrame([(-1, None, None)], "id long, memory_type string, importance double")
    return rows.unionByName(new.select("id", F.coalesce("memory_type", F.lit("insight")).alias("memory_type"), F.coalesce("importance", F.lit(0.5)).alias("importance")))


@query("S16_batch_update", "SELECT id, access_count + (id % 2)::INT AS access_count FROM memories")
def batch_update(spark, sf):
    rows = tables.memories(spark, sf).select("id", "access_count")
    changes = rows.where("id % 2 = 1").select("id", (F.col("access_count") + 1).alias("access_count"))
    return snapshots.update(rows, changes, "id", ["access_count"])


@query("S17_replace_text", "SELECT id, CASE WHEN id % 7 = 0 THEN 'new ' || id ELSE content END AS content FROM memories")
def replace_text(spark, sf):
    rows = tables.memories(spark, sf).select("id", "content")
    return snapshots.update(rows, rows.where("id % 7 = 0").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("content")), "id", ["content"])


@query("S20_working_memory_json", "SELECT session_id, started_at, turn_id, role, content FROM messages JOIN sessions USING (session_id)")
def working_memory_json(spark, sf):
    """A session as lines of JSON, its header first and then a line for each message, so that no session has to fit into one value; read back from the lines."""
    header = tables.sessions(spark, sf).select("session_id", F.to_json(F.struct("session_id", "started_at")).alias("line"))
    message = tables.messages(spark, sf).select("session_id", F.to_json(F.struct("session_id", "turn_id", "role", "content")).alias("line"))
    lines = header.unionByName(message).select(F.from_json("line", "session_id long, started_at timestamp, turn_id long, role string, content string").alias("m")).select("m.*")
    begun = lines.where("started_at IS NOT NULL").select("session_id", "started_at")
    return lines.where("started_at IS NULL").drop("started_at").join(begun, "session_id").select("session_id", "started_at", "turn_id", "role", "content")


@query("S21_graph_json", "SELECT '[\"' || source_id || '|x\",\"' || target_id || '\"]' AS key, source_id || '|x' AS a, target_id AS b FROM relations")
def graph_json(spark, sf):
    """Relations by a key of both ends, as a list in JSON: ids may hold any character."""
    rows = tables.relations(spark, sf).select(F.to_json(F.array(F.concat("source_id", F.lit("|x")), "target_id")).alias("key"))
    ends = F.from_json("key", "array<string>")
    return rows.select("key", ends[0].alias("a"), ends[1].alias("b"))


@query("S27_access_sink", "SELECT id, left('query ' || id, 200) AS query, len(memory_ids) AS n FROM accesses")
def access_sink(spark, sf):
    return tables.accesses(spark, sf).select("id", F.substring(F.concat(F.lit("query "), F.col("id").cast("string")), 1, 200).alias("query"), F.size("memory_ids").cast("long").alias("n"))


@query("S32_artifact_names", "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) || '_' || left(md5(url), 8) AS name FROM pages")
def artifact_names(spark, sf):
    host = F.parse_url("url", F.lit("HOST"))
    return tables.read(spark, sf, "pages").select("page_id", F.concat(host, F.lit("_"), F.substring(F.md5("url"), 1, 8)).alias("name"))


@query("S42_page_memories", f"""
WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'ftp://' || url WHEN 1 THEN NULL ELSE url END AS url, repeat(html, 40) AS html FROM pages)
SELECT page_id, '[URL: ' || url || ']' || chr(10) || left(html, 2000) AS content, 'reference' AS memory_type, length(left(html, 50000)) AS chars,
CASE WHEN regexp_matches(lower(html), {quoted(rules.any_of(rules.WORTHY))}) THEN 0.55 ELSE 0.4 END::DOUBLE AS importance FROM p WHERE starts_with(url, 'http://') OR starts_with(url, 'https://')""")  # fmt: skip
def page_memories(spark, sf):
    """Pages of the web, some of them long, some by addresses that aren't read."""
    k = F.col("page_id") % 7
    rows = tables.read(spark, sf, "pages").select("page_id", F.when(k == 0, F.concat(F.lit("ftp://"), "url")).when(k != 1, F.col("url")).alias("url"), F.repeat("html", F.lit(40)).alias("html"))
    return web.page_memories(rows, "page_id", "url", "html", context=F.col("html"))


@query("S43_embedding_cache_key", "SELECT doc_id, left(sha256(left(text, 500)), 16) || ':doc' AS key FROM documents")
def embedding_cache_key(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", F.concat(F.substring(F.sha2(F.substring("text", 1, 500), 256), 1, 16), F.lit(":doc")).alias("key"))


@query("K03_case_folding", "SELECT entity_id FROM entities WHERE lower(name) = lower('NaTioN_3')")
def case_folding(spark, sf):
    return tables.entities(spark, sf).where(F.lower("name") == "NaTioN_3".lower()).select("entity_id")


@query("K04_escaped_pattern", r"SELECT entity_id FROM entities WHERE name ILIKE '%r\_1%' ESCAPE '\' OR name ILIKE '%an%'")
def escaped_pattern(spark, sf):
    return tables.entities(spark, sf).where(F.col("name").ilike(r"%r\_1%") | F.col("name").ilike("%an%")).select("entity_id")


@query("K09_objects", "SELECT n_regionkey, string_agg('{\"k\":' || n_nationkey || '}', ',' ORDER BY n_nationkey) AS objects FROM nation GROUP BY 1")
def objects(spark, sf):
    rows = tables.read(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_set("n_nationkey")).alias("ks"))
    return rows.select("n_regionkey", F.array_join(F.transform("ks", lambda k: F.to_json(F.struct(k.alias("k")))), ",").alias("objects"))


@query("K15_interval", "SELECT id FROM memories WHERE created_at > TIMESTAMP '2024-02-01' - to_days(11)")
def interval(spark, sf):
    return tables.memories(spark, sf).where(F.col("created_at") > tables.now() - F.make_interval(days=F.lit(11))).select("id")


@query("K17_text_time", "SELECT id FROM interactions WHERE ts < TIMESTAMP '2024-01-05'")
def text_time(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return tables.interactions(spark, sf).where(parsed < F.lit("2024-01-05").cast("timestamp")).select("id")


@query("K20_branches", "SELECT id, CASE WHEN access_count > 4 THEN 'hot' WHEN access_count > 1 THEN 'warm' ELSE 'cold' END AS heat FROM memories")
def branches(spark, sf):
    n = F.col("access_count")
    return tables.memories(spark, sf).select("id", F.when(n > 4, "hot").when(n > 1, "warm").otherwise("cold").alias("heat"))


@query("K23_sample_by_hash", "SELECT id FROM memories ORDER BY md5(id::VARCHAR), id LIMIT 10")
def sample_by_hash(spark, sf):
    return tables.memories(spark, sf).orderBy(F.md5(F.col("id").cast("string")), "id").limit(10).select("id")


@query("D03_future_created", "SELECT id, round(CASE WHEN id % 2 = 0 THEN importance ELSE decayed END, 6) AS decayed FROM (SELECT *, " + DECAYED + " AS decayed FROM memories)")
def future_created(spark, sf):
    later = F.when(F.col("id") % 2 == 0, tables.now() + F.expr("interval 3 days")).otherwise(F.col("created_at"))
    return with_decay(tables.memories(spark, sf).withColumn("created_at", later)).select("id", F.round("decayed", 6).alias("decayed"))


@query("F35_working_search", "SELECT session_id, turn_id FROM messages WHERE contains(lower(content), 'und')")
def working_search(spark, sf):
    return tables.messages(spark, sf).where(F.contains(F.lower("content"), F.lit("und"))).select("session_id", "turn_id")


@query("J09_query_scan", f"WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 2) SELECT vec_id, round(1 - {COSINE.format('embedding', 'v')}, 6) AS distance FROM embeddings CROSS JOIN q WHERE 1 - {COSINE.format('embedding', 'v')} < 0.9")
def query_scan(spark, sf):
    v = tables.read(spark, sf, "embeddings")
    near = similarity.to_query(v, similarity.vector_of(v, 2)).select("vec_id", (1 - F.col("similarity")).alias("distance"))
    return near.where("distance < 0.9").withColumn("distance", F.round("distance", 6))


@query("J24_path_pairs", f"""
WITH {EDGES}, near AS (SELECT 's:1' AS n UNION SELECT b FROM edges WHERE a = 's:1'), found AS (SELECT n FROM near ORDER BY n LIMIT 11),
pairs AS (SELECT x.n AS source, y.n AS target FROM found x JOIN found y ON x.n < y.n ORDER BY 1, 2 LIMIT 10), {levels('SELECT DISTINCT source AS start FROM pairs', 3)}
SELECT source, target, distance, array_to_string(path, '>') AS path FROM ({reached(3)}) JOIN pairs ON source = start AND target = node""")  # fmt: skip
def path_pairs(spark, sf):
    found = graph.neighbours(tables.relations(spark, sf), spark.createDataFrame([("s:1",)], "start string"), 1).select(F.col("node").alias("n")).orderBy("n").limit(11)
    pairs = found.crossJoin(F.broadcast(found.withColumnRenamed("n", "m"))).where("n < m").orderBy("n", "m").limit(10).select(F.col("n").alias("source"), F.col("m").alias("target"))  # eleven entities
    return graph.shortest_paths(tables.relations(spark, sf), pairs, 3).withColumn("path", F.array_join("path", ">"))


@query("L02_hybrid_rank")
def hybrid_rank(spark, sf):
    m = tables.memories(spark, sf)
    v = similarity.of_memories(tables.read(spark, sf, "embeddings"), m)
    asked = m.where("id = 0").select("content").first()
    near = similarity.to_query(v, similarity.vector_of(v, 0)).orderBy(F.desc("similarity"), "vec_id").limit(20)
    rows = m.select("id", "content").join(F.broadcast(near), F.col("id") == F.col("vec_id"))
    score = 0.7 * F.col("similarity") + 0.3 * similarity.block_ratio(F.col("content"), F.lit(asked[0] if asked else ""))
    return rows.select("id", score.alias("score")).where("score >= 0.1").orderBy(F.desc("score"), "id").limit(10).withColumn("score", F.round("score", 6))


@query("L07_old_sample", "SELECT session_id, turn_id FROM messages WHERE ts < TIMESTAMP '2024-02-01' - INTERVAL 2 DAY ORDER BY md5(session_id || ':' || turn_id) LIMIT 5")
def old_sample(spark, sf):
    old = tables.messages(spark, sf).where(F.col("ts") < tables.now() - F.expr("interval 2 days"))
    return old.orderBy(F.md5(F.concat_ws(":", "session_id", "turn_id"))).limit(5).select("session_id", "turn_id")


@query("L09_section_order", "SELECT id, row_number() OVER (ORDER BY id % 5, id) AS place FROM memories")
def section_order(spark, sf):
    """Sections by priority, those of one priority as they came."""
    rows = tables.memories(spark, sf).select("id", (F.col("id") % 5).alias("priority"))
    return selection.placed(rows, [F.asc("priority"), F.asc("id")]).select("id", "place")


@query("L11_recent_tasks", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_tasks(spark, sf):
    return tables.read(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey")


@query("G09_entity_add", "SELECT lower(name) AS key, min(entity_id) AS entity_id, coalesce(min(CASE WHEN entity_type <> 'region' THEN entity_type END), 'region') AS entity_type FROM entities GROUP BY 1")
def entity_add(spark, sf):
    kind = F.coalesce(F.min(F.when(F.col("entity_type") != "region", F.col("entity_type"))), F.lit("region"))
    return tables.entities(spark, sf).groupBy(F.lower("name").alias("key")).agg(F.min("entity_id").alias("entity_id"), kind.alias("entity_type"))


ASKED = "trade of asia with nation_3 and nation_7".split()


@query("G12_keyword_query", f"""
WITH {EDGES}, w AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{w}')" for k, w in enumerate(w for w in ASKED if len(w) > 2))}) t(place, word)),
hits AS (SELECT place, entity_id, row_number() OVER (PARTITION BY place ORDER BY mentions DESC, entity_id) AS k FROM w JOIN entities ON contains(lower(name), word)),
seeds AS (SELECT DISTINCT entity_id AS start FROM (SELECT * FROM hits WHERE k <= 2 ORDER BY place, k LIMIT 3)), {levels('SELECT start FROM seeds', 2)}
SELECT entity_id, mentions FROM entities WHERE entity_id IN (SELECT node FROM ({reached(2)})) ORDER BY mentions DESC, entity_id LIMIT 5""")  # fmt: skip
def keyword_query(spark, sf):
    found, _ = graph.keyword_query(tables.entities(spark, sf), tables.relations(spark, sf), ASKED)
    return found.select("entity_id", "mentions")


@query("X14_chunks")
def chunks(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", F.posexplode(texts.chunked(F.col("text"), 2000)).alias("place", "chunk"))


@query("X33_insights", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\d+[.)]\s*', '')), lambda x: length(x) > 10)[1:3], '|') AS insights FROM documents")
def insights(spark, sf):
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\d+[.)]\s*", "")), lambda x: F.char_length(x) > 10)
    return tables.read(spark, sf, "documents").select("doc_id", F.array_join(F.slice(lines, 1, 3), "|").alias("insights"))


@query("X44_text_parts", "SELECT session_id, turn_id, content || ' ' || role AS text, (turn_id % 3)::INT AS images FROM messages")
def text_parts(spark, sf):
    """Messages whose content is a list of texts and images in JSON: the texts, and how many images."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    images = F.transform(F.sequence(F.lit(0), F.col("turn_id") % 3), lambda k: part("image", F.concat(F.lit("data:image/"), k.cast("string"))))
    content = F.concat(F.array(part("text", F.col("content"))), F.slice(images, F.lit(1), (F.col("turn_id") % 3).cast("int")), F.array(part("text", F.col("role"))))
    rows = tables.messages(spark, sf).select("session_id", "turn_id", F.to_json(content).alias("content"))
    parts = F.from_json("content", "array<struct<type:string,value:string>>")
    kind = lambda name: F.filter("parts", lambda p: p["type"] == name)
    return rows.select("session_id", "turn_id", parts.alias("parts")).select("session_id", "turn_id", F.array_join(F.transform(kind("text"), lambda p: p["value"]), " ").alias("text"), F.size(kind("image")).alias("images"))


@query("Y07_range_records", "SELECT id, created_at::DATE AS start, (created_at::DATE + 1)::DATE AS finish FROM memories")
def range_records(spark, sf):
    day = F.to_date("created_at")
    return tables.memories(spark, sf).select("id", day.alias("start"), F.date_add(day, 1).alias("finish"))


@query("Y10_korean_age", "SELECT id, CASE WHEN h < 1 THEN '방금' WHEN h < 24 THEN floor(h)::INT || '시간 전' WHEN h // 24 = 1 THEN '어제' WHEN h // 24 < 7 THEN (h // 24)::INT || '일 전' WHEN h // 24 < 30 THEN (h // 24 // 7)::INT || '주 전' ELSE (h // 24 // 30)::INT || '개월 전' END AS label FROM (SELECT id, (epoch(TIMESTAMP '2024-02-01') - epoch(created_at))::BIGINT // 3600 AS h FROM memories)")
def korean_age(spark, sf):
    hours = (F.unix_timestamp(tables.now()) - F.unix_timestamp("created_at")) / 3600
    return tables.memories(spark, sf).select("id", texts.korean_age(hours, F.col("created_at")).alias("label"))


@query("Y14_time_context", "SELECT '2024-02-01 00:00' AS now, CASE WHEN s < 3600 THEN 'continued' WHEN s < 86400 THEN 'same day' ELSE (s // 86400)::BIGINT || ' days' END AS since FROM (SELECT (epoch(TIMESTAMP '2024-02-01') - epoch(max(ended_at)))::BIGINT AS s FROM sessions)")
def time_context(spark, sf):
    s = F.unix_timestamp(tables.now()) - F.unix_timestamp(F.max("ended_at"))
    since = F.when(s < 3600, "continued").when(s < 86400, "same day").otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit(" days")))
    return tables.sessions(spark, sf).agg(F.date_format(tables.now(), "yyyy-MM-dd HH:mm").alias("now"), since.alias("since"))


@query("T01_event_records", "SELECT event_id, event_type, ts::TIMESTAMP AS ts, json_extract_string(props, '$.k') AS k FROM events")
def event_records(spark, sf):
    return tables.read(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.from_json("props", "map<string,string>")["k"].alias("k"))


@query("T12_session_router", "SELECT user_id, channel_id, count(*) AS events, max(ts) AS last_seen FROM accesses GROUP BY 1, 2")
def session_router(spark, sf):
    return tables.accesses(spark, sf).groupBy("user_id", "channel_id").agg(F.count("*").alias("events"), F.max("ts").alias("last_seen"))


@query("P14_retrieve_context", f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 5), near AS (SELECT vec_id, {COSINE.format('embedding', 'v')} AS s FROM embeddings CROSS JOIN q WHERE vec_id IN (SELECT id FROM memories) ORDER BY s DESC, vec_id LIMIT 10)
SELECT m.id, CASE WHEN m.created_at > TIMESTAMP '2024-02-01' - INTERVAL 24 HOUR THEN 'LATEST' ELSE 'OLD' END AS age, row_number() OVER (ORDER BY m.created_at DESC, m.id) AS place FROM near JOIN memories m ON m.id = near.vec_id""")  # fmt: skip
def retrieve_context(spark, sf):
    v = tables.read(spark, sf, "embeddings")
    near = F.broadcast(similarity.to_query(similarity.of_memories(v, tables.memories(spark, sf)), similarity.vector_of(v, 5)).orderBy(F.desc("similarity"), "vec_id").limit(10))
    rows = tables.memories(spark, sf).join(near, F.col("id") == F.col("vec_id"))
    age = F.when(F.col("created_at") > tables.now() - F.expr("interval 24 hours"), "LATEST").otherwise("OLD")
    return rows.select("id", age.alias("age"), F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).cast("long").alias("place"))
