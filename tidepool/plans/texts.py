"""Queries of text, date, JSON and page rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import texts
from tidepool.operators import html
from tidepool.plans.registry import query
from tidepool.sources import tables

WS = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def docs(spark, sf):
    return tables.read(spark, sf, "documents")


@query("X01_truncate", r"SELECT doc_id, CASE WHEN length(text) > 300 THEN regexp_replace(left(text, 284), '\s+$', '') || chr(10) || '... (truncated)' ELSE text END AS text FROM documents")
def truncate(spark, sf):
    return docs(spark, sf).select("doc_id", texts.truncate(F.col("text"), 300).alias("text"))


@query("X02_content_key", rf"SELECT doc_id, left({WS.format(r"regexp_replace(regexp_replace(regexp_replace(" + WS.format("lower(text)") + ", '" + "|".join(texts.PARTICLES).replace("'", "''") + r"', '', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')")}, 100) AS key FROM documents".replace("{{", "{").replace("}}", "}"))
def content_key(spark, sf):
    return docs(spark, sf).select("doc_id", texts.repeat_key(F.col("text")).alias("key"))


@query("X03_name_key", r"SELECT entity_id, trim(regexp_replace(translate(lower(name), '_-()', '    '), '\s+', ' ', 'g')) AS key FROM entities")
def name_key(spark, sf):
    return tables.entities(spark, sf).select("entity_id", texts.name_key(F.col("name")).alias("key"))


@query("X04_core_name", "SELECT entity_id, trim(regexp_extract(name, '^([^_(]+)', 1)) AS core FROM entities")
def core_name(spark, sf):
    return tables.entities(spark, sf).select("entity_id", texts.core_name(F.col("name")).alias("core"))


@query("X05_relation_names", "SELECT source_id, target_id, CASE relation_type WHEN 'part_of' THEN 'belongs_to' WHEN 'located_in' THEN 'belongs_to' ELSE relation_type END AS relation_type FROM relations")
def relation_names(spark, sf):
    table = F.create_map(*[F.lit(x) for x in ("part_of", "belongs_to", "located_in", "belongs_to")])
    return tables.relations(spark, sf).select("source_id", "target_id", F.coalesce(F.try_element_at(table, F.col("relation_type")), "relation_type").alias("relation_type"))


@query("X12_content_hash", rf"SELECT doc_id, sha256(left(lower({WS.format('text')}), 500)) AS hash FROM documents")
def content_hash(spark, sf):
    return docs(spark, sf).select("doc_id", texts.content_key(F.col("text")).alias("hash"))


@query("X13_short_hash", rf"SELECT doc_id, md5(left(lower({WS.format('text')}), 200)) AS hash FROM documents")
def short_hash(spark, sf):
    return docs(spark, sf).select("doc_id", texts.short_key(F.col("text")).alias("hash"))


@query("X21_urls", """SELECT page_id, array_to_string(regexp_extract_all(html, 'https?://[^\\s<>"'')]+'), ' ') AS urls FROM pages""")
def urls(spark, sf):
    return tables.read(spark, sf, "pages").select("page_id", F.array_join(texts.urls(F.col("html")), " ").alias("urls"))


@query("X25_bullets", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10))[1:10], lambda x: '- ' || left(x, 200)), chr(10)) || CASE WHEN len(string_split(text, chr(10))) > 10 THEN chr(10) || '... ' || (len(string_split(text, chr(10))) - 10) || ' more' ELSE '' END AS bullets FROM documents")
def bullets(spark, sf):
    lines = F.split("text", "\n")
    shown = F.array_join(F.transform(F.slice(lines, 1, 10), lambda x: F.concat(F.lit("- "), F.substring(x, 1, 200))), "\n")
    more = F.when(F.size(lines) > 10, F.concat(F.lit("\n... "), (F.size(lines) - 10).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return docs(spark, sf).select("doc_id", F.concat(shown, more).alias("bullets"))


@query("X27_context_line", "SELECT id, '[' || memory_type || '|' || round(importance * 100)::INT || '%] ' || left(content, 100) AS line FROM memories")
def context_line(spark, sf):
    head = F.concat(F.lit("["), "memory_type", F.lit("|"), F.round(F.col("importance") * 100).cast("int").cast("string"), F.lit("%] "))
    return tables.memories(spark, sf).select("id", F.concat(head, F.substring("content", 1, 100)).alias("line"))


@query("X30_style", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?。]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda x: contains(lower(x), 'the'))) / len(s)::DOUBLE, 3) ELSE 0 END AS hedges, CASE WHEN len(s) > 0 THEN round(list_sum(list_transform(s, lambda x: len(regexp_split_to_array(x, '\s+')))) / len(s)::DOUBLE, 1) ELSE 0 END AS words FROM s""")
def style(spark, sf):
    return docs(spark, sf).select("doc_id", texts.style(F.col("text"), ("the",)).alias("s")).select("doc_id", "s.hedges", "s.words")


@query("X31_roles", "SELECT conv_id, turn, CASE WHEN lower(role) IN ('user', 'human') THEN 'user' WHEN lower(role) IN ('assistant', 'model', 'ai') THEN 'assistant' ELSE lower(role) END AS role FROM conversations")
def roles(spark, sf):
    low = F.lower("role")
    return tables.read(spark, sf, "conversations").select("conv_id", "turn", F.when(low.isin("user", "human"), "user").when(low.isin("assistant", "model", "ai"), "assistant").otherwise(low).alias("role"))


@query("X40_html_text")
def html_text(spark, sf):
    """Pages without what isn't content."""
    return html.clean(tables.read(spark, sf, "pages"), "page_id", "html")


@query("X41_markdown")
def html_markdown(spark, sf):
    return html.to_markdown(tables.read(spark, sf, "pages"), "page_id", "url", "html")


@query("Y08_relative_label", "SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minutes ago' WHEN s < 86400 THEN (s // 3600) || ' hours ago' ELSE (s // 86400) || ' days ago' END AS label FROM (SELECT id, epoch(TIMESTAMP '2024-02-01')::BIGINT - epoch(ts)::BIGINT AS s FROM interactions)")
def relative_label(spark, sf):
    # the fraction of a second rounds as DuckDB's cast does
    s = F.unix_timestamp(tables.now()) - F.rint(F.unix_micros("ts") / 1e6).cast("long")
    unit = lambda n, word: F.concat(F.floor(s / n).cast("string"), F.lit(f" {word} ago"))
    label = F.when(s < 60, "just now").when(s < 3600, unit(60, "minutes")).when(s < 86400, unit(3600, "hours")).otherwise(unit(86400, "days"))
    return tables.interactions(spark, sf).select("id", label.alias("label"))


@query("Y11_age_label", "SELECT id, CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN floor(h)::INT || ' hours ago' WHEN h < 168 THEN floor(h / 24)::INT || ' days ago' WHEN h < 720 THEN floor(floor(h / 24) / 7)::INT || ' weeks ago' ELSE floor(floor(h / 24) / 30)::INT || ' months ago' END AS label FROM (SELECT id, (epoch(TIMESTAMP '2024-02-01') - epoch(created_at)) / 3600 AS h FROM memories)")
def age_label(spark, sf):
    hours = (F.unix_timestamp(tables.now()) - F.unix_timestamp("created_at")) / 3600
    return tables.memories(spark, sf).select("id", texts.age_label(hours).alias("label"))


@query("Y12_many_formats", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE date_trunc('day', o_orderdate::TIMESTAMP) END AS ts FROM orders")
def many_formats(spark, sf):
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    written = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format(day, "MM/dd/yyyy")).otherwise("no time")
    return tables.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), texts.any_time(written).alias("ts"))


@query("Y13_recency_label", "SELECT id, CASE WHEN created_at > TIMESTAMP '2024-02-01' - INTERVAL 24 HOUR THEN 'LATEST' ELSE 'OLD' END AS label FROM memories")
def recency_label(spark, sf):
    return tables.memories(spark, sf).select("id", F.when(F.col("created_at") > tables.now() - F.expr("interval 24 hours"), "LATEST").otherwise("OLD").alias("label"))


@query("K07_json_array_rows", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_rows(spark, sf):
    return tables.read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("K08_map_merge", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS name, n_regionkey::VARCHAR AS region FROM nation")
def map_merge(spark, sf):
    old = F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string"))
    new = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("name"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    merged = F.map_concat(kept, new)  # the right side wins, whatever the session's policy for repeated keys
    return tables.read(spark, sf, "nation").select("n_nationkey", merged["name"].alias("name"), merged["region"].alias("region"))


@query("K13_json_from_text", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_from_text(spark, sf):
    text = F.concat(F.lit("answer: "), F.col("props"), F.lit(" done"))
    return tables.read(spark, sf, "events").select("event_id", F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), "k long")["k"].alias("k"))


@query("K12_json_encode", "SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS names FROM nation GROUP BY 1")
def json_encode(spark, sf):
    return tables.read(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list("n_name"))).alias("names"))
