"""Queries of the smaller rules: arrays, maps, dates, labels, ranks and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.functions import dates, rules, scores, texts
from tidepool.operators import duplicates, selection, similarity, snapshots, vectors
from tidepool.plans.registry import query
from tidepool.plans.rules import listed, pick, picked, quoted
from tidepool.plans.scoring import COSINE, DECAYED, with_decay
from tidepool.sources import tables


@query("D07_circadian_bonus", "SELECT id, (hour(ts) IN (9, 10, 20))::INT AS bonus FROM interactions")
def circadian_bonus(spark, sf):
    peaks = F.array(*map(F.lit, (9, 10, 20)))
    return tables.interactions(spark, sf).select("id", F.array_contains(peaks, F.hour("ts")).cast("int").alias("bonus"))


@query("D21_cosine_batch", f"WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 11) SELECT vec_id, round({COSINE.format('embedding', 'v')}, 6) AS similarity FROM embeddings CROSS JOIN q")
def cosine_batch(spark, sf):
    v = tables.read(spark, sf, "embeddings")
    return similarity.to_query(v, similarity.vector_of(v, 11)).withColumn("similarity", F.round("similarity", 6))


@query("D22_text_ratio")
def text_ratio(spark, sf):
    docs = tables.read(spark, sf, "documents")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(other, "doc_id").select("doc_id", F.round(similarity.block_ratio(F.col("text"), F.col("other")), 6).alias("ratio"))


@query("D25_one_against_many", "SELECT p_partkey, round(1 - levenshtein(p_name, 'green almond') / greatest(strlen(p_name), 12)::DOUBLE, 6) AS similarity FROM part")
def one_against_many(spark, sf):
    return tables.read(spark, sf, "part").select("p_partkey", F.round(scores.string_similarity(F.col("p_name"), F.lit("green almond")), 6).alias("similarity"))


@query("F03_type_and_time", "SELECT id FROM memories WHERE memory_type = 'fact' AND created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-20'")
def type_and_time(spark, sf):
    return tables.memories(spark, sf).where("memory_type = 'fact' AND created_at BETWEEN timestamp '2024-01-01' AND timestamp '2024-01-20'").select("id")


@query("F06_topic_like", "SELECT id FROM memories WHERE ('[\"' || topic || '\"]') LIKE '%src1%'")
def topic_like(spark, sf):
    return tables.memories(spark, sf).where(F.to_json(F.array("topic")).like("%src1%")).select("id")


@query("F11_case_insensitive", "SELECT entity_id FROM entities WHERE lower(name) = lower('China') OR lower(name) = lower('aSIA')")
def case_insensitive(spark, sf):
    wanted = spark.createDataFrame([("China",), ("aSIA",)], "w string").select(F.lower("w").alias("key"))
    return tables.entities(spark, sf).withColumn("key", F.lower("name")).join(F.broadcast(wanted), "key").select("entity_id")


@query("F12_line_filter", "SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(lower(line), 'license')")
def line_filter(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.contains(F.lower("line"), F.lit("license")))


@query("F19_eviction_predicate", f"SELECT id FROM memories WHERE {DECAYED} < 0.1 AND repetitions < 3 AND access_count < 3 AND created_at < TIMESTAMP '2024-02-01' - INTERVAL 168 HOUR")
def eviction_predicate(spark, sf):
    return with_decay(tables.memories(spark, sf)).where("decayed < 0.1 AND repetitions < 3 AND access_count < 3").where(F.col("created_at") < tables.now() - F.expr("interval 168 hours")).select("id")


@query("F26_protected", "SELECT session_id, turn_id FROM messages QUALIFY turn_id <= max(turn_id) OVER (PARTITION BY session_id) - 4 AND NOT contains(content, '!')")
def protected(spark, sf):
    last = F.max("turn_id").over(Window.partitionBy("session_id"))
    return tables.messages(spark, sf).withColumn("last", last).where("turn_id <= last - 4").where(~F.contains("content", F.lit("!"))).select("session_id", "turn_id")


#: One of each kind of what is cleaned, and some that only look so.
SPOTS = ("", "😀", "사과 (apple pie)", "apple (사과)", "“so”", "[System note]", "[SYSTEM]", "[Semantic x]", "[기억/일기]", "[OTHER]", "plain (text)", "\u200b", "⭐", "사과", "사과(1)", "ⓐ", "🄰", "〰", "it's")


@query("F28_needs_cleaning", f"SELECT doc_id FROM documents WHERE regexp_matches(text || ' ' || {picked(SPOTS, 'doc_id')}, {quoted('|'.join(rules.UNCLEAN).replace('[^]]', '[^\\]]'))})")
def needs_cleaning(spark, sf):
    said = F.concat("text", F.lit(" "), pick(SPOTS, F.col("doc_id")))
    return tables.read(spark, sf, "documents").where(rules.needs_cleaning(said)).select("doc_id")


@query("F29_threshold", "SELECT entity_id, mentions / 9.0 >= 0.6 AS kept FROM entities")
def threshold(spark, sf):
    return tables.entities(spark, sf).select("entity_id", (F.col("mentions") / 9.0 >= 0.6).alias("kept"))


KINDS = ("concept", "concept", "person")


@query("F30_stop_words", f"""
WITH w AS (SELECT doc_id, {picked(KINDS, 'doc_id')} AS kind, list_distinct(string_split(lower(text), ' ') || [{picked(rules.STOP_WORDS, 'doc_id // 3')}, upper({picked(rules.STOP_WORDS, 'doc_id // 3')}) || ' ']) AS names FROM documents),
n AS (SELECT kind, unnest(names) AS name FROM w)
SELECT kind, name, count(*) AS n FROM n WHERE NOT (kind = 'concept' AND lower(trim(name)) IN ({', '.join(map(quoted, rules.STOP_WORDS))})) GROUP BY ALL""")  # fmt: skip
def stop_words(spark, sf):
    """The words of each document as concepts or persons, with one of the stop words each, once more in capitals."""
    word = pick(rules.STOP_WORDS, F.floor(F.col("doc_id") / 3))
    names = F.array_distinct(F.concat(F.split(F.lower("text"), " "), F.array(word, F.concat(F.upper(word), F.lit(" ")))))
    rows = tables.read(spark, sf, "documents").select(pick(KINDS, F.col("doc_id")).alias("kind"), F.explode(names).alias("name"))
    return rows.where(~rules.names_nothing(F.col("name"), F.col("kind"))).groupBy("kind", "name").agg(F.count("*").alias("n"))


@query("F31_domain", "SELECT entity_id FROM entities WHERE starts_with(entity_id, 's:') AND EXISTS (SELECT 1 FROM relations WHERE source_id = entity_id)")
def domain(spark, sf):
    known = tables.relations(spark, sf).select(F.col("source_id").alias("entity_id"))
    return tables.entities(spark, sf).where(F.col("entity_id").startswith("s:")).join(known, "entity_id", "left_semi").select("entity_id")


@query("F33_visibility", "SELECT model, count(*) AS n FROM interactions WHERE model NOT IN ('view') AND tier NOT IN ('tier2') AND reason IS NOT NULL GROUP BY 1")
def visibility(spark, sf):
    c = F.col
    return tables.interactions(spark, sf).where(~c("model").isin("view") & ~c("tier").isin("tier2") & c("reason").isNotNull()).groupBy("model").agg(F.count("*").alias("n"))


@query("F34_recent_messages", "SELECT session_id, turn_id FROM messages WHERE ts >= TIMESTAMP '2024-01-01 10:00:00' ORDER BY ts DESC, session_id, turn_id LIMIT 60")
def recent_messages(spark, sf):
    return tables.messages(spark, sf).where("ts >= timestamp '2024-01-01 10:00:00'").orderBy(F.desc("ts"), "session_id", "turn_id").limit(60).select("session_id", "turn_id")


@query("F37_confidence_label", "SELECT id, CASE WHEN importance >= 0.85 THEN 'sure' ELSE 'likely' END AS label FROM memories WHERE importance >= 0.3")
def confidence_label(spark, sf):
    return tables.memories(spark, sf).where("importance >= 0.3").select("id", F.when(F.col("importance") >= 0.85, "sure").otherwise("likely").alias("label"))


@query("F38_novel", "WITH t AS (SELECT 'p' || p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'x' || n_nationkey, 'a ' || n_name || '!' FROM nation WHERE n_nationkey % 2 = 0) SELECT id FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.id <> a.id AND (contains(lower(a.name), lower(b.name)) OR contains(lower(b.name), lower(a.name))))")
def novel(spark, sf):
    part, nation = tables.read(spark, sf, "part"), tables.read(spark, sf, "nation")
    rows = part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"))
    rows = rows.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name")))
    rows = rows.unionByName(nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("x"), "n_nationkey").alias("id"), F.concat(F.lit("a "), "n_name", F.lit("!")).alias("name")))
    return similarity.novel(rows, "id", "name").select("id")


@query("J05_traversal_attributes", "SELECT r.source_id, e.name, e.entity_type FROM relations r JOIN entities e ON e.entity_id = r.target_id WHERE r.relation_type <> 'part_of'")
def traversal_attributes(spark, sf):
    names = tables.entities(spark, sf).select(F.col("entity_id").alias("target_id"), "name", "entity_type")
    return tables.relations(spark, sf).where("relation_type <> 'part_of'").join(names, "target_id").select("source_id", "name", "entity_type")


@query("J06_undirected_edges", "SELECT source_id AS a, target_id AS b FROM relations UNION SELECT target_id, source_id FROM relations")
def undirected_edges(spark, sf):
    from tidepool.operators import graph

    return graph.symmetric(tables.relations(spark, sf))


@query("J07_summary_row", "SELECT (SELECT count(*) FROM memories) AS memories, (SELECT max(ts) FROM messages) AS last_message, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM interactions) AS calls")
def summary_row(spark, sf):
    one = tables.memories(spark, sf).agg(F.count("*").alias("memories")).crossJoin(tables.messages(spark, sf).agg(F.max("ts").alias("last_message")))
    return one.crossJoin(tables.entities(spark, sf).agg(F.count("*").alias("entities"))).crossJoin(tables.interactions(spark, sf).agg(F.count("*").alias("calls")))  # one row each


@query("J08_lateral_top", "SELECT s.start, r.target_id, r.weight FROM (SELECT unnest(['s:1', 's:2', 's:3']) AS start) s, LATERAL (SELECT target_id, weight FROM relations WHERE source_id = s.start ORDER BY weight DESC, target_id LIMIT 10) r")
def lateral_top(spark, sf):
    wanted = F.broadcast(spark.createDataFrame([("s:1",), ("s:2",), ("s:3",)], "source_id string"))
    rows = tables.relations(spark, sf).join(wanted, "source_id")
    return selection.newest(rows, ["source_id"], [F.desc("weight"), F.asc("target_id")], 10).select(F.col("source_id").alias("start"), "target_id", "weight")


@query("J14_word_matches", "WITH w AS (SELECT unnest(['green', 'blue', 'asia']) AS word) SELECT word, entity_id FROM w JOIN entities ON contains(lower(name), word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY mentions DESC, entity_id) <= 2")
def word_matches(spark, sf):
    # the words of one query are few: each entity is tested against them in place, without a join
    words = F.array(*map(F.lit, ("green", "blue", "asia")))
    rows = tables.entities(spark, sf).select("entity_id", "mentions", F.explode(F.filter(words, lambda w: F.contains(F.lower("name"), w))).alias("word"))
    return selection.newest(rows, ["word"], [F.desc("mentions"), F.asc("entity_id")], 2).select("word", "entity_id")


ALIAS_VALUES = ", ".join(f"({quoted(name)}, {quoted(other)})" for name, others in rules.ALIASES.items() for other in others)
#: Ids and names of entities of the known groups; the given tables have none.
NAMED = [x for k, (name, others) in enumerate(rules.ALIASES.items()) for x in (*([name] if k != 1 else []), *others, others[0].upper())] + ["Docker (engine)", "docker-compose", "_docker", "dockers"]
NAMED_SQL = f"SELECT n AS entity_id, n AS name, (length(n) % 9 + 1)::BIGINT AS mentions FROM (SELECT unnest({listed(NAMED)}) AS n)"


def with_named(spark, sf):
    named = spark.createDataFrame([(n, n, len(n) % 9 + 1) for n in NAMED], "entity_id string, name string, mentions long")
    return tables.entities(spark, sf).select("entity_id", "name", "mentions").unionByName(named)


@query("J15_aliases", f"""
WITH a(canonical, alias) AS (VALUES {ALIAS_VALUES}), e AS (SELECT entity_id FROM entities UNION ALL SELECT entity_id FROM ({NAMED_SQL}))
SELECT e.entity_id, a.canonical AS canonical_id FROM e JOIN a ON a.alias = lower(e.entity_id) WHERE a.canonical IN (SELECT entity_id FROM e)""")  # fmt: skip
def aliases(spark, sf):
    return duplicates.canonical(with_named(spark, sf), duplicates.alias_table(spark, rules.ALIASES))


#: SQL: a name with the marks that a key leaves out.
_KEY = "trim(regexp_replace(translate(lower({}), '_-()', '    '), '\\s+', ' ', 'g'))"
_CORE = "CASE WHEN regexp_matches(name, '^[_(]') THEN name ELSE trim(regexp_extract(name, '^([^_(]+)', 1)) END"


@query("J25_merge_candidates", f"""
WITH a(canonical, alias) AS (VALUES {ALIAS_VALUES}), e AS (SELECT entity_id, name, mentions FROM entities UNION ALL {NAMED_SQL}),
k AS (SELECT entity_id, mentions, {_KEY.format('(' + _CORE + ')')} AS core, {_KEY.format('name')} AS key FROM e),
known AS (SELECT a.canonical AS keep, e.entity_id AS remove, 1.0::DOUBLE AS similarity, 1 AS rule FROM e JOIN a ON a.alias = lower(e.entity_id) WHERE a.canonical IN (SELECT entity_id FROM e)),
cores AS (SELECT core, first(entity_id ORDER BY mentions DESC, entity_id) AS keep FROM k GROUP BY core),
keys AS (SELECT key, first(entity_id ORDER BY mentions DESC, entity_id) AS keep, max(mentions) AS mentions FROM k GROUP BY key),
near AS (
  SELECT CASE WHEN y.mentions > x.mentions OR y.mentions = x.mentions AND y.keep < x.keep THEN y.keep ELSE x.keep END AS keep, CASE WHEN y.mentions > x.mentions OR y.mentions = x.mentions AND y.keep < x.keep THEN x.keep ELSE y.keep END AS remove,
    1 - levenshtein(x.key, y.key) / greatest(strlen(x.key), strlen(y.key))::DOUBLE AS similarity, 3 AS rule
  FROM keys x JOIN keys y ON x.key < y.key AND abs(strlen(x.key) - strlen(y.key)) <= 0.2 * greatest(strlen(x.key), strlen(y.key))
), pairs AS (
  SELECT * FROM known UNION ALL SELECT keep, entity_id, 0.95, 2 FROM k JOIN cores USING (core) WHERE entity_id <> keep
  UNION ALL SELECT keep, entity_id, 1.0, 3 FROM k JOIN keys USING (key) WHERE entity_id <> keep UNION ALL SELECT * FROM near WHERE similarity >= 0.85
)
SELECT keep, remove, round(similarity, 6) AS similarity, rule FROM pairs QUALIFY row_number() OVER (PARTITION BY least(keep, remove), greatest(keep, remove) ORDER BY rule, keep) = 1""")  # fmt: skip
def merge_candidates(spark, sf):
    """All entities, and some with names of the known groups, with joiners and with brackets."""
    found = duplicates.duplicate_entities(with_named(spark, sf), duplicates.alias_table(spark, rules.ALIASES))
    return found.withColumn("similarity", F.round("similarity", 6))


@query("J20_connection_counts", "SELECT e.entity_id, coalesce(d.n, 0) AS connections FROM entities e LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM relations UNION ALL SELECT target_id FROM relations) GROUP BY id) d ON d.id = e.entity_id")
def connection_counts(spark, sf):
    ends = tables.relations(spark, sf).select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("n"))
    return tables.entities(spark, sf).join(ends, "entity_id", "left").select("entity_id", F.coalesce("n", F.lit(0)).alias("connections"))


@query("J22_session_exists", "SELECT i.id, s.session_id FROM interactions i LEFT JOIN sessions s ON s.session_id = i.conversation_id")
def session_exists(spark, sf):
    s = tables.sessions(spark, sf).select("session_id")
    return tables.interactions(spark, sf).join(s, F.col("conversation_id") == F.col("session_id"), "left").select("id", "session_id")


@query("A14_partners", "SELECT id, count(DISTINCT other) AS partners FROM (SELECT source_id AS id, target_id AS other FROM relations UNION ALL SELECT target_id, source_id FROM relations) GROUP BY id")
def partners(spark, sf):
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("o")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("o"))))
    return tables.relations(spark, sf).select(ends.alias("e")).groupBy("e.id").agg(F.count_distinct("e.o").alias("partners"))


@query("A30_hit_rate", "SELECT model, count(*) AS n, round(count(*) FILTER (NOT refused) / count(*)::DOUBLE, 6) AS rate FROM interactions GROUP BY 1")
def hit_rate(spark, sf):
    return tables.interactions(spark, sf).groupBy("model").agg(F.count("*").alias("n"), F.round(F.count_if(~F.col("refused")) / F.count("*"), 6).alias("rate"))


@query("A35_database_stats", "SELECT 'memories' AS name, count(*) AS n FROM memories UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relations', count(*) FROM relations")
def database_stats(spark, sf):
    parts = [f(spark, sf).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, f in (("memories", tables.memories), ("entities", tables.entities), ("relations", tables.relations))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("A36_error_counts", "SELECT model, count(*) FILTER (refused) AS errors, count(*) FILTER (refused) >= 30 AS over FROM interactions GROUP BY 1")
def error_counts(spark, sf):
    n = F.count_if("refused")
    return tables.interactions(spark, sf).groupBy("model").agg(n.alias("errors"), (n >= 30).alias("over"))


@query("W02_best_per_group", "SELECT topic, id FROM memories QUALIFY row_number() OVER (PARTITION BY topic ORDER BY importance DESC, id) = 1")
def best_per_group(spark, sf):
    return selection.best_per_group(tables.memories(spark, sf), ["topic"], [F.desc("importance"), F.asc("id")]).select("topic", "id")


@query("W14_newest_in_order", "SELECT session_id, turn_id FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) <= 3")
def newest_in_order(spark, sf):
    return selection.newest(tables.messages(spark, sf), ["session_id"], [F.desc("turn_id")], 3).select("session_id", "turn_id")


@query("L05_eviction_cap", "SELECT id FROM memories WHERE importance < 0.2 ORDER BY id LIMIT greatest(0, least(200, (SELECT count(*) FROM memories) - 3))")
def eviction_cap(spark, sf):
    rows = tables.memories(spark, sf)
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    first = rows.where("importance < 0.2").orderBy("id").limit(200)
    return first.withColumn("k", F.row_number().over(Window.orderBy("id"))).crossJoin(total).where("k <= total - 3").select("id")


@query("L08_domains", "SELECT split_part(entity_id, ':', 1) AS domain, count(*) AS n FROM entities GROUP BY 1 ORDER BY n DESC, domain LIMIT 30")
def domains(spark, sf):
    return tables.entities(spark, sf).groupBy(F.substring_index("entity_id", ":", 1).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(30)


@query("L10_distinct_cap", "SELECT target_id, max(weight) AS weight FROM relations GROUP BY 1 ORDER BY 1 LIMIT 100")
def distinct_cap(spark, sf):
    return tables.relations(spark, sf).groupBy("target_id").agg(F.max("weight").alias("weight")).orderBy("target_id").limit(100)


@query("U02_neighbour_union", "SELECT target_id AS node FROM relations WHERE source_id IN ('s:1', 's:2') UNION SELECT source_id FROM relations WHERE target_id IN ('s:1', 's:2') UNION SELECT unnest(['s:1', 's:2'])")
def neighbour_union(spark, sf):
    seeds = ["s:1", "s:2"]
    r = tables.relations(spark, sf)
    nodes = r.where(F.col("source_id").isin(seeds)).select(F.col("target_id").alias("node")).union(r.where(F.col("target_id").isin(seeds)).select("source_id"))
    return nodes.union(spark.createDataFrame([(s,) for s in seeds], "node string")).distinct()


@query("U05_known_minus_applied", "SELECT n_name FROM nation EXCEPT SELECT n_name FROM nation WHERE n_regionkey = 2")
def known_minus_applied(spark, sf):
    n = tables.read(spark, sf, "nation")
    return n.select("n_name").exceptAll(n.where("n_regionkey = 2").select("n_name"))


@query("U08_two_sides", "SELECT id, CASE WHEN importance < 0.3 THEN 'deleted' ELSE 'kept' END AS side FROM memories")
def two_sides(spark, sf):
    return tables.memories(spark, sf).select("id", F.when(F.col("importance") < 0.3, "deleted").otherwise("kept").alias("side"))


@query("K01_next_number", "SELECT coalesce(max(turn_id), -1) + 1 AS next FROM messages WHERE session_id = 3")
def next_number(spark, sf):
    return tables.messages(spark, sf).where("session_id = 3").agg((F.coalesce(F.max("turn_id"), F.lit(-1)) + 1).alias("next"))


@query("K02_text_length", "SELECT doc_id, length(text) AS n FROM documents")
def text_length(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("K05_regex_match", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}\\.[0-9]{3}')")
def regex_match(spark, sf):
    return tables.read(spark, sf, "documents").where(F.col("text").rlike(r"[0-9]{3}\.[0-9]{3}")).select("doc_id")


@query("K06_array_contains", "SELECT id FROM accesses WHERE list_contains(memory_ids, 7)")
def array_contains(spark, sf):
    return tables.accesses(spark, sf).where(F.array_contains("memory_ids", F.lit(7).cast("long"))).select("id")


@query("K10_array_append", "SELECT id, array_to_string(list_append(memory_ids, channel_id), ',') AS ids FROM accesses")
def array_append(spark, sf):
    return tables.accesses(spark, sf).select("id", F.array_join(F.array_append("memory_ids", F.col("channel_id")).cast("array<string>"), ",").alias("ids"))


@query("K11_in_array", "SELECT id FROM memories WHERE id IN (3, 5, 8, 13)")
def in_array(spark, sf):
    return tables.memories(spark, sf).where(F.col("id").isin(3, 5, 8, 13)).select("id")


@query("K14_date_arithmetic", "SELECT session_id, (min(ts)::DATE + 1)::DATE AS tomorrow FROM messages GROUP BY 1")
def date_arithmetic(spark, sf):
    return tables.messages(spark, sf).groupBy("session_id").agg(F.date_add(F.to_date(F.min("ts")), 1).alias("tomorrow"))


@query("K16_seconds_between", "SELECT session_id, (epoch(ended_at) - epoch(started_at))::BIGINT AS seconds FROM sessions")
def seconds_between(spark, sf):
    return tables.sessions(spark, sf).select("session_id", (F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")).alias("seconds"))


@query("K18_conditional_counts", "SELECT conversation_id, count(*) FILTER (refused) AS refused, sum(CASE WHEN tool_calls > 0 THEN tokens_in ELSE 0 END)::BIGINT AS tokens FROM interactions GROUP BY 1")
def conditional_counts(spark, sf):
    return tables.interactions(spark, sf).groupBy("conversation_id").agg(F.count_if("refused").alias("refused"), F.sum(F.when(F.col("tool_calls") > 0, F.col("tokens_in")).otherwise(0)).alias("tokens"))


@query("K19_null_order", "SELECT session_id, row_number() OVER (ORDER BY summary DESC NULLS LAST, session_id) AS place FROM sessions")
def null_order(spark, sf):
    return selection.placed(tables.sessions(spark, sf).select("session_id", "summary"), [F.desc_nulls_last("summary"), F.asc("session_id")]).select("session_id", "place")


@query("K21_upsert", "SELECT id, CASE WHEN id % 3 = 0 THEN 1.0 ELSE importance END::DOUBLE AS importance FROM memories UNION ALL SELECT -1, 1.0")
def upsert(spark, sf):
    rows = tables.memories(spark, sf).select("id", "importance")
    new = rows.where("id % 3 = 0").select("id", F.lit(1.0).alias("importance")).unionByName(spark.createDataFrame([(-1, 1.0)], "id long, importance double"))
    return snapshots.upsert(rows, new, ["id"])


@query("K22_deleted_rows", "SELECT id, topic FROM memories WHERE importance < 0.05")
def deleted_rows(spark, sf):
    return tables.memories(spark, sf).where("importance < 0.05").select("id", "topic")


@query("X09_strip_text", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[“”]', '"', 'g'), '[‘’]', '''', 'g'), '\[[A-Z_]+\]', '', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def strip_text(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", texts.cleaned(F.col("text")).alias("text"))


@query("X24_artifact", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'saved:' || length(text) ELSE text END AS text FROM documents")
def artifact(spark, sf):
    n = F.char_length("text")
    return tables.read(spark, sf, "documents").select("doc_id", F.when(n > 2000, F.concat(F.lit("saved:"), n.cast("string"))).otherwise(F.col("text")).alias("text"))


@query("X26_section_budget", "SELECT doc_id, CASE WHEN length(text) // 4 <= 100 THEN text ELSE left(text, 300) END AS section FROM documents")
def section_budget(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", F.when(scores.tokens(F.col("text")) <= 100, F.col("text")).otherwise(F.substring("text", 1, 300)).alias("section"))


@query("X34_tagged_block", r"SELECT doc_id, regexp_extract('START' || left(text, 40) || 'END' || text, '(?s)START(.*?)END', 1) AS block FROM documents")
def tagged_block(spark, sf):
    return tables.read(spark, sf, "documents").select("doc_id", F.regexp_extract(F.concat(F.lit("START"), F.substring("text", 1, 40), F.lit("END"), "text"), "(?s)START(.*?)END", 1).alias("block"))


@query("X39_labels", "SELECT id, CASE WHEN model IN ('click', 'view', 'purchase') THEN model ELSE 'neutral' END AS label FROM interactions")
def labels(spark, sf):
    return tables.interactions(spark, sf).select("id", F.when(F.col("model").isin("click", "view", "purchase"), F.col("model")).otherwise("neutral").alias("label"))


def _abbreviated_sql(text: str) -> str:
    for long, short in rules.ABBREVIATIONS:
        text = f"replace(replace({text}, {quoted(long.capitalize())}, {quoted(short.upper())}), {quoted(long)}, {quoted(short)})"
    return text


TERMS = [x for long, _ in rules.ABBREVIATIONS for x in (long, long.capitalize(), long.upper())]


@query("X42_abbreviation", f"SELECT doc_id, {_abbreviated_sql('text || chr(32) || ' + picked(TERMS, 'doc_id'))} AS text FROM documents")
def abbreviation(spark, sf):
    said = F.concat("text", F.lit(" "), pick(TERMS, F.col("doc_id")))
    return tables.read(spark, sf, "documents").select("doc_id", texts.abbreviated(said, rules.ABBREVIATIONS).alias("text"))


@query("Y06_iso_date", "SELECT o_orderkey AS id, o_orderdate::DATE AS day FROM orders")
def iso_date(spark, sf):
    text = F.concat(F.lit("on "), F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd"), F.lit("?"))
    return tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), dates.any_day(text, tables.now()).alias("day"))


@query("P04_semantic_groups", "SELECT topic, count(*) AS n FROM memories WHERE memory_type = 'conversation' AND created_at <= TIMESTAMP '2024-02-01' - INTERVAL 5 DAY AND repetitions >= 2 GROUP BY topic HAVING count(*) >= 2")
def semantic_groups(spark, sf):
    rows = tables.memories(spark, sf).where("memory_type = 'conversation' AND repetitions >= 2").where(F.col("created_at") <= tables.now() - F.expr("interval 5 days"))
    return rows.groupBy("topic").agg(F.count("*").alias("n")).where("n >= 2")


@query("P05_vector_gc", f"""
SELECT DISTINCT CASE WHEN x.importance < y.importance OR (x.importance = y.importance AND x.id < y.id) THEN x.id ELSE y.id END AS id
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id JOIN memories x ON x.id = a.vec_id JOIN memories y ON y.id = b.vec_id WHERE {COSINE.format('a.embedding', 'b.embedding')} >= 0.35""".replace("x.importance = y.importance AND x.id < y.id", "x.importance = y.importance AND x.id > y.id"))  # fmt: skip
def vector_gc(spark, sf):
    pairs = vectors.near_vectors(tables.read(spark, sf, "embeddings"), 0.35)
    value = tables.memories(spark, sf).select("id", "importance")
    rows = pairs.join(value.select(F.col("id").alias("a"), F.col("importance").alias("x")), "a").join(value.select(F.col("id").alias("b"), F.col("importance").alias("y")), "b")
    return rows.select(F.when(F.col("x") < F.col("y"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()


@query("P09_verification", "SELECT count(*) FILTER (content IS NULL) AS nulls, count(*) FILTER (length(content) > 5000) AS long, count(*) - count(DISTINCT id) AS repeated FROM memories")
def verification(spark, sf):
    return tables.memories(spark, sf).agg(F.count_if(F.col("content").isNull()).alias("nulls"), F.count_if(F.char_length("content") > 5000).alias("long"), (F.count("*") - F.count_distinct("id")).alias("repeated"))


@query("T15_cron_check", "SELECT minute FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01 23:59:00', INTERVAL 1 MINUTE)) AS minute) WHERE minute(minute) IN (0, 30) AND hour(minute) IN (8, 20)")
def cron_check(spark, sf):
    from tidepool.operators import filters

    spine = spark.sql("SELECT explode(sequence(timestamp '2024-01-01', timestamp '2024-01-01 23:59:00', interval 1 minute)) AS minute")
    return spine.where(filters.cron("0,30 8,20 * * *", F.col("minute")))
