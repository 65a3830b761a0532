"""Queries of scores, retrieval and similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.functions import scores
from tidepool.operators import similarity, vectors
from tidepool.plans.registry import query
from tidepool.sources import tables

HOURS = "greatest(0, epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch({}))::DOUBLE / 3600"
RATE_OF_TYPE = "CASE memory_type WHEN 'fact' THEN 0.3 WHEN 'preference' THEN 0.5 WHEN 'insight' THEN 0.7 ELSE 1.0 END::DOUBLE"
FADED = f"importance * exp(-0.001 * {RATE_OF_TYPE} / (1 + 0.2 * channels) / (1 + 0.3 * ln(1 + access_count)) * (1 - least(1.0, 0.1 * connection_count)) * {HOURS.format('created_at')})"
DECAYED = f"greatest(0.3 * importance, CASE WHEN {HOURS.format('created_at')} > 168 AND {HOURS.format('last_accessed')} < 24 THEN 1.3 * {FADED} ELSE {FADED} END)"


def with_decay(df):
    c = F.col
    return df.withColumn("decayed", scores.decay(c("importance"), c("created_at"), c("last_accessed"), c("memory_type"), c("access_count"), c("connection_count"), c("channels"), tables.now()))


@query("D01_decay", f"SELECT id, round({DECAYED}, 6) AS decayed FROM memories")
def decay(spark, sf):
    return with_decay(tables.memories(spark, sf)).select("id", F.round("decayed", 6).alias("decayed"))


@query("D02_batch_decay_missing", f"SELECT id, round(CASE WHEN id % 10 = 0 THEN 0.5 ELSE {DECAYED} END, 6) AS decayed FROM memories")
def decay_missing(spark, sf):
    rows = tables.memories(spark, sf).withColumn("created_at", F.when(F.col("id") % 10 != 0, F.col("created_at")))
    return with_decay(rows).select("id", F.round("decayed", 6).alias("decayed"))


@query("D05_type_multiplier", f"SELECT memory_type, {RATE_OF_TYPE} AS rate, count(*) AS n FROM memories GROUP BY 1, 2")
def type_multiplier(spark, sf):
    return tables.memories(spark, sf).groupBy("memory_type", scores.type_rate(F.col("memory_type")).alias("rate")).agg(F.count("*").alias("n"))


@query("D06_age_hours", f"SELECT id, round({HOURS.format('created_at')}, 6) AS hours FROM memories")
def age_hours(spark, sf):
    return tables.memories(spark, sf).select("id", F.round(scores.hours_between(F.col("created_at"), tables.now()), 6).alias("hours"))


@query("D09_engagement", "SELECT conversation_id, round((least(1.0, (epoch(max(ts)) - epoch(min(ts))) / 1800.0) + least(1.0, avg(tool_calls) / 5.0) + greatest(0.0, least(1.0, (5000 - avg(latency_ms)) / 4500.0))) / 3, 6) AS engagement FROM interactions GROUP BY 1")
def engagement(spark, sf):
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    rows = tables.interactions(spark, sf).groupBy("conversation_id").agg(seconds.alias("seconds"), F.avg("tool_calls").alias("tools"), F.avg("latency_ms").alias("latency"))
    return rows.select("conversation_id", F.round(scores.engagement(F.col("seconds"), F.col("tools"), F.col("latency")), 6).alias("engagement"))


@query("D08_dynamic_rate", "SELECT conversation_id, round(greatest(0.0005, least(0.002, 0.002 * (0.8 + 0.4 * least(1.0, count(DISTINCT hour(ts)) / 16.0)))), 6) AS rate FROM interactions GROUP BY 1")
def dynamic_rate(spark, sf):
    rows = tables.interactions(spark, sf).groupBy("conversation_id").agg(F.count_distinct(F.hour("ts")).alias("hours"))
    return rows.select("conversation_id", F.round(scores.dynamic_rate(F.col("hours")), 6).alias("rate"))


SIMPLE = f"greatest(0.3, exp(-0.001 / (1 + 0.3 * ln(1 + m.access_count)) * {HOURS.format('m.created_at')}))"
COSINE = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_inner_product({1}::DOUBLE[], {1}::DOUBLE[])))"


@query("D10_retrieval_score", f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)
SELECT m.id, round({COSINE.format('e.embedding', 'q.v')} * {SIMPLE} * (0.5 + 0.5 * m.importance), 6) AS score
FROM memories m JOIN embeddings e ON e.vec_id = m.id CROSS JOIN q""")  # fmt: skip
def retrieval_score(spark, sf):
    vectors = tables.read(spark, sf, "embeddings")
    scored = similarity.to_query(vectors, similarity.vector_of(vectors, 0)).join(tables.memories(spark, sf), F.col("vec_id") == F.col("id"))
    decayed = scores.simple_decay(F.lit(1.0), F.col("created_at"), F.col("access_count"), tables.now())
    return scored.select("id", F.round(scores.retrieval(F.col("similarity"), F.col("importance"), decayed), 6).alias("score"))


@query("D11_temporal_boost", "SELECT id, round(CASE WHEN created_at::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-15' THEN importance * 0.6 + 0.32 ELSE importance END, 6) AS score FROM memories")
def temporal_boost(spark, sf):
    return tables.memories(spark, sf).select("id", F.round(scores.temporal_boost(F.col("importance"), F.to_date("created_at"), "2024-01-10", "2024-01-15"), 6).alias("score"))


@query("D17_importance_from_text", "SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(text, '(0\\.\\d+|1\\.0|1)', 1), '') AS DOUBLE), 0.5) AS importance FROM documents")
def importance_from_text(spark, sf):
    found = F.regexp_extract("text", r"(0\.\d+|1\.0|1)", 1)
    return tables.read(spark, sf, "documents").select("doc_id", F.coalesce(F.when(found != "", found).cast("double"), F.lit(0.5)).alias("importance"))


@query("D19_token_estimate", "SELECT id, length(content) // 4 AS tokens FROM memories")
def token_estimate(spark, sf):
    return tables.memories(spark, sf).select("id", scores.tokens(F.col("content")).alias("tokens"))


@query("D20_cosine", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COSINE.format('a.embedding', 'b.embedding')}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf):
    v = tables.read(spark, sf, "embeddings")
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(scores.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("D23_byte_levenshtein")
def byte_levenshtein(spark, sf):
    docs = tables.read(spark, sf, "documents")
    return docs.select("doc_id", scores.byte_distance(F.col("text"), F.concat("lang", "source", "text")).cast("long").alias("distance"))


@query("D24_string_similarity", "SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name) / greatest(strlen(a.p_name), strlen(b.p_name))::DOUBLE, 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def string_similarity(spark, sf):
    p = tables.read(spark, sf, "part")
    a, b = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")), p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(scores.string_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("D27_backoff", "SELECT n AS attempt, least(60.0, 2.0 ** (n - 1))::DOUBLE AS seconds FROM range(1, 12) t(n)")
def backoff(spark, sf):
    return spark.range(1, 12).select(F.col("id").alias("attempt"), scores.backoff(F.col("id")).alias("seconds"))


@query("L01_semantic_query", f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id, {COSINE.format('embedding', 'v')} AS similarity FROM embeddings CROSS JOIN q WHERE vec_id IN (SELECT id FROM memories) ORDER BY similarity DESC, vec_id LIMIT 15)
SELECT m.id, round(n.similarity * {SIMPLE} * (0.5 + 0.5 * m.importance), 6) AS score FROM near n JOIN memories m ON m.id = n.vec_id
ORDER BY n.similarity * {SIMPLE} * (0.5 + 0.5 * m.importance) DESC, m.id LIMIT 10""")  # fmt: skip
def semantic_query(spark, sf):
    return similarity.semantic_query(tables.memories(spark, sf), tables.read(spark, sf, "embeddings"), 0, 10, tables.now())


@query("L03_nearest_above", f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7)
SELECT * FROM (SELECT vec_id, round({COSINE.format('embedding', 'v')}, 6) AS similarity FROM embeddings CROSS JOIN q WHERE vec_id <> 7 ORDER BY {COSINE.format('embedding', 'v')} DESC, vec_id LIMIT 1) WHERE similarity >= 0.2""")  # fmt: skip
def nearest_above(spark, sf):
    v = tables.read(spark, sf, "embeddings")
    near = similarity.to_query(v.where("vec_id <> 7"), similarity.vector_of(v, 7)).orderBy(F.desc("similarity"), "vec_id").limit(1)
    return near.where("similarity >= 0.2").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("L04_k_nearest", f"""
WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 3)
SELECT vec_id, round(1 - {COSINE.format('embedding', 'v')}, 6) AS distance FROM embeddings CROSS JOIN q ORDER BY {COSINE.format('embedding', 'v')} DESC, vec_id LIMIT 20""")  # fmt: skip
def k_nearest(spark, sf):
    v = tables.read(spark, sf, "embeddings")
    near = similarity.to_query(v, similarity.vector_of(v, 3)).orderBy(F.desc("similarity"), "vec_id").limit(20)
    return near.select("vec_id", F.round(1 - F.col("similarity"), 6).alias("distance"))


@query("J10_hot_memory_bonus", """
WITH used AS (SELECT unnest(memory_ids) AS id FROM accesses), hot AS (SELECT id FROM used GROUP BY id ORDER BY count(*) DESC, id LIMIT 20)
SELECT m.id, round(m.importance + CASE WHEN h.id IS NOT NULL THEN 0.1 ELSE 0 END, 6) AS score FROM memories m LEFT JOIN hot h USING (id)""")  # fmt: skip
def hot_memory_bonus(spark, sf):
    hot = tables.accesses(spark, sf).select(F.explode("memory_ids").alias("id")).groupBy("id").count().orderBy(F.desc("count"), "id").limit(20).select("id", F.lit(0.1).alias("bonus"))
    return tables.memories(spark, sf).join(F.broadcast(hot), "id", "left").select("id", F.round(F.col("importance") + F.coalesce("bonus", F.lit(0.0)), 6).alias("score"))


@query("J11_near_duplicate_vectors", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COSINE.format('a.embedding', 'b.embedding')}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COSINE.format('a.embedding', 'b.embedding')} >= 0.35")
def near_duplicate_vectors(spark, sf):
    return vectors.near_vectors(tables.read(spark, sf, "embeddings"), 0.35).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("J12_near_duplicate_strings", """
SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name) / greatest(strlen(a.p_name), strlen(b.p_name))::DOUBLE, 6) AS similarity
FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_brand = b.p_brand
WHERE 1 - levenshtein(a.p_name, b.p_name) / greatest(strlen(a.p_name), strlen(b.p_name))::DOUBLE >= 0.7""")  # fmt: skip
def near_duplicate_strings(spark, sf):
    parts = tables.read(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return similarity.near_strings(parts, "p_partkey", "p_name", 0.7, block="p_brand", digits=6)


@query("W05_top_edges", "SELECT source_id, target_id, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id, relation_type) AS rank FROM relations) WHERE rank <= 10")
def top_edges(spark, sf):
    w = Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id", "relation_type")
    return tables.relations(spark, sf).select("source_id", "target_id", "weight", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 10")
