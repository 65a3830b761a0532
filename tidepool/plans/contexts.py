"""Queries of assembled contexts and of what a conversation leaves behind: stores, graphs from texts, reports, landed search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import rules, scores, texts
from tidepool.operators import graph, selection, similarity, vectors
from tidepool.plans.graph import EDGES, levels, reached
from tidepool.plans.registry import query
from tidepool.plans.rules import quoted
from tidepool.plans.scoring import COSINE
from tidepool.sources import tables

QUESTION = "trade of asia with nation_3 and nation_7"


def lines(df: DataFrame, order: list[str], line, sep: str = "\n") -> DataFrame:
    """(text): one row with the lines of a few rows in their order; none if there are no rows."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("rows"))
    return rows.where(F.size("rows") > 0).select(F.array_join(F.transform("rows", lambda x: x["line"]), sep).alias("text"))


def assembled(sections: list[tuple[str, int, int, DataFrame]]) -> DataFrame:
    """(place, section, text, tokens) of sections (name, priority, most characters, one row of text) that aren't blank, each cut to its budget,
    by priority and then as they came."""
    parts = None
    for k, (name, priority, most, df) in enumerate(sections):
        part = df.where(F.trim("text") != "").select(F.lit(priority).alias("priority"), F.lit(k).alias("k"), F.lit(name).alias("section"), texts.truncate(F.col("text"), most).alias("text"))
        parts = part if parts is None else parts.unionByName(part)
    place = F.row_number().over(Window.orderBy("priority", "k"))  # a handful of sections
    return parts.select(place.alias("place"), "section", "text", scores.tokens(F.col("text")).alias("tokens"))


def recent_lines(spark, sf, n: int) -> DataFrame:
    m = tables.messages(spark, sf).orderBy(F.desc("ts"), "session_id", "turn_id").limit(n)
    return lines(m, ["ts", "session_id", "turn_id"], F.concat("role", F.lit(": "), "content"))


def remembered(spark, sf, n: int, words: list[str]) -> DataFrame:
    """The most important memories that name one of the words, with their scores."""
    m = tables.memories(spark, sf).where(F.lower("content").rlike(rules.any_of(tuple(words)))).orderBy(F.desc("importance"), "id").limit(n)
    return lines(m, ["id"], F.concat(F.lit("- ["), F.format_string("%.2f", "importance"), F.lit("] "), F.substring("content", 1, 200), F.lit("...")))


def hot(spark, sf, n: int) -> DataFrame:
    used = tables.accesses(spark, sf).select(F.explode("memory_ids").alias("id"), "channel_id").groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("channel_id").alias("c"))
    top = used.orderBy(F.desc("n"), "id").limit(n)
    return lines(top, ["n", "id"], F.concat(F.lit("- "), F.col("id").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(" times, "), F.col("c").cast("string"), F.lit(" channels)")))


def latest_events(spark, sf, n: int) -> DataFrame:
    e = tables.interactions(spark, sf).orderBy(F.desc("ts"), F.desc("id")).limit(n)
    return lines(e, ["ts", "id"], F.concat(F.lit("- ["), "model", F.lit("] "), F.date_format("ts", "HH:mm")))


def graph_text(spark, sf, found: DataFrame, near: DataFrame) -> DataFrame:
    """Entities and relations (a few of each) as lines."""
    names = tables.entities(spark, sf).select("entity_id", "name", "entity_type")
    e = found.select("entity_id").join(names, "entity_id").select(F.lit(0).alias("part"), F.col("entity_id").alias("k"), F.concat(F.lit("- **"), "name", F.lit("** ("), "entity_type", F.lit(")")).alias("line"))
    a, b = (names.select(F.col("entity_id").alias(end), F.col("name").alias(to)) for end, to in (("source_id", "a"), ("target_id", "b")))
    r = near.join(a, "source_id").join(b, "target_id").select(F.lit(1).alias("part"), F.concat("source_id", "target_id").alias("k"), F.concat(F.lit("- "), "a", F.lit(" --["), "relation_type", F.lit("]--> "), "b").alias("line"))
    return lines(e.unionByName(r), ["part", "k"], F.col("line"))


@query("P11_budgeted_context")
def budgeted_context(spark, sf):
    """The eight sections of a prompt, each within its budget."""
    one = lambda text: spark.range(1).select(F.lit(text).alias("text"))
    found, near = graph.keyword_query(tables.entities(spark, sf), tables.relations(spark, sf), QUESTION.split())
    summaries = tables.sessions(spark, sf).where("summary IS NOT NULL").orderBy(F.desc("ended_at"), "session_id").limit(5)
    return assembled([
        ("system_prompt", 1, 4000, one("You keep what was said.")), ("temporal", 1, 500, one(f"now: {tables.NOW}")), ("working_memory", 1, 5000, recent_lines(spark, sf, 20)), ("long_term", 1, 3000, remembered(spark, sf, 10, QUESTION.split())),
        ("graph", 1, 2000, graph_text(spark, sf, found, near)), ("session_archive", 1, 2000, lines(summaries, ["ended_at", "session_id"], F.col("summary"))), ("event_buffer", 2, 800, latest_events(spark, sf, 5)), ("hot_memories", 2, 600, hot(spark, sf, 5)),
    ])


@query("P10_smart_context")
def smart_context(spark, sf):
    """The graph first; the question with the names of three entities found there asks the memories; then the sections that have something."""
    found, near = graph.keyword_query(tables.entities(spark, sf), tables.relations(spark, sf), QUESTION.split())
    names = tables.entities(spark, sf).join(F.broadcast(found.select("entity_id")), "entity_id", "left_semi").orderBy(F.desc("mentions"), "entity_id").limit(3)
    asked = [*QUESTION.split(), *(r[0].lower() for r in names.select("name").collect())]  # three names
    return assembled([
        ("conversation", 1, 5000, recent_lines(spark, sf, 20)), ("long_term", 2, 3000, remembered(spark, sf, 10, [w for w in asked if len(w) > 2])), ("graph", 3, 2000, graph_text(spark, sf, found, near)),
        ("event_buffer", 4, 800, latest_events(spark, sf, 5)), ("hot_memories", 5, 600, hot(spark, sf, 5)),
    ])


@query("X28_graph_context", """WITH e AS (SELECT entity_id, name, entity_type FROM entities WHERE entity_type = 'nation' ORDER BY mentions DESC, entity_id LIMIT 5),
r AS (SELECT r.*, a.name AS a, b.name AS b FROM relations r JOIN entities a ON a.entity_id = r.source_id JOIN entities b ON b.entity_id = r.target_id WHERE r.relation_type = 'part_of' ORDER BY weight DESC, source_id LIMIT 10)
SELECT string_agg(line, chr(10) ORDER BY part, k) AS text FROM (SELECT 0 AS part, entity_id AS k, '- **' || name || '** (' || entity_type || ')' AS line FROM e UNION ALL SELECT 1, source_id || target_id, '- ' || a || ' --[' || relation_type || ']--> ' || b FROM r)""")  # fmt: skip
def graph_context(spark, sf):
    e = tables.entities(spark, sf).where("entity_type = 'nation'").orderBy(F.desc("mentions"), "entity_id").limit(5)
    r = tables.relations(spark, sf).where("relation_type = 'part_of'").orderBy(F.desc("weight"), "source_id").limit(10)
    return graph_text(spark, sf, e, r)


@query("G13_graph_query", f"""
WITH {EDGES}, named AS (SELECT entity_id AS start FROM entities WHERE lower(name) IN ('nation_3', 'nation_7', 'asia')), {levels('SELECT start FROM named', 4)},
around AS (SELECT DISTINCT node FROM ({reached(2)})), top AS (SELECT entity_id FROM entities WHERE entity_id IN (SELECT node FROM around) ORDER BY mentions DESC, entity_id LIMIT 5)
SELECT 'entity' AS kind, entity_id AS what FROM top UNION ALL SELECT 'path', array_to_string(path, '>') FROM ({reached(4)}) WHERE start < node AND node IN (SELECT start FROM named)""")  # fmt: skip
def graph_query(spark, sf):
    """The relations and shortest paths between entities that were found in a question, with the entities around them."""
    named = tables.entities(spark, sf).where(F.lower("name").isin("nation_3", "nation_7", "asia")).select(F.col("entity_id").alias("start"))
    around = graph.neighbours(tables.relations(spark, sf), named, 2).select(F.col("node").alias("entity_id")).distinct()
    top = tables.entities(spark, sf).join(around, "entity_id").orderBy(F.desc("mentions"), "entity_id").limit(5).select(F.lit("entity").alias("kind"), F.col("entity_id").alias("what"))
    pairs = named.select(F.col("start").alias("source")).crossJoin(F.broadcast(named.select(F.col("start").alias("target")))).where("source < target")  # three entities
    paths = graph.shortest_paths(tables.relations(spark, sf), pairs, 4).select(F.lit("path").alias("kind"), F.array_join("path", ">").alias("what"))
    return top.unionByName(paths)


_NAMED = "SELECT d.doc_id, 'n:' || n.n_nationkey AS entity_id FROM documents d JOIN nation n ON n.n_nationkey IN (d.doc_id % 25, d.doc_id * 7 % 25) OR contains(lower(d.text), lower(n.n_name)) JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1"


def named(spark, sf) -> DataFrame:
    """(doc_id, entity_id): the nations that good documents name; each document is given two of them."""
    good = tables.read(spark, sf, "labels").where("quality = 1").select("doc_id")
    nations = [(r[0], r[1].lower()) for r in tables.few(tables.read(spark, sf, "nation").select("n_nationkey", "n_name"))]
    known = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(n).alias("name")) for k, n in nations])
    low = F.lower("text")
    found = F.filter(known, lambda x: (x["k"] == F.col("doc_id") % 25) | (x["k"] == F.col("doc_id") * 7 % 25) | F.contains(low, x["name"]))
    return tables.read(spark, sf, "documents").join(good, "doc_id", "left_semi").select("doc_id", F.explode(found).alias("n")).select("doc_id", F.concat(F.lit("n:"), F.col("n.k").cast("string")).alias("entity_id"))


@query("G14_extraction", f"WITH m AS ({_NAMED}) SELECT entity_id, count(*) AS mentions FROM m GROUP BY 1 HAVING count(*) >= 2")
def extraction(spark, sf):
    """Entities that texts name, added up; those named once only aren't stored."""
    return named(spark, sf).groupBy("entity_id").agg(F.count("*").alias("mentions")).where("mentions >= 2")


@query("P17_graph_population", f"WITH m AS ({_NAMED}) SELECT a.entity_id AS source_id, b.entity_id AS target_id, count(*) AS seen, round(0.5 + 0.1 * (count(*) - 1), 6)::DOUBLE AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.entity_id < b.entity_id GROUP BY 1, 2")
def graph_population(spark, sf):
    """Relations between entities of one document; one that comes again gains weight. A document names a few entities of a fixed list."""
    rows = named(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_set("entity_id")).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = rows.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("source_id"), F.col("p.b").alias("target_id")).agg(F.count("*").alias("seen"))
    return rows.withColumn("weight", F.round(0.5 + 0.1 * (F.col("seen") - 1), 6))


@query("P01_store", f"""WITH m AS (SELECT id, importance, sha256(left(lower(trim(content)), 500)) AS key, id % 5 = 0 AS fresh FROM memories WHERE content IS NOT NULL),
n AS (SELECT key, min(id) AS id, count(*) AS times, max(importance) AS best FROM m WHERE fresh GROUP BY key),
near AS (SELECT DISTINCT a.vec_id AS id FROM embeddings a JOIN embeddings b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0 AND b.vec_id IN (SELECT id FROM m) AND {COSINE.format('a.embedding', 'b.embedding')} >= 0.45)
SELECT n.id, times, CASE WHEN NOT (best >= 0.55 OR times >= 2 AND best >= 0.35) THEN 'rejected' WHEN n.key IN (SELECT key FROM m WHERE NOT fresh) THEN 'repeated' WHEN n.id IN (SELECT id FROM near) THEN 'merged' ELSE 'stored' END AS outcome FROM n""")  # fmt: skip
def store(spark, sf):
    """What becomes of every fifth memory, if it comes to a store of the others: its key and how often it came, the promotion, a memory of
    the same key, one whose vector is near, else it is put in."""
    key = F.sha2(F.substring(F.lower(F.trim("content")), 1, 500), 256)
    m = tables.memories(spark, sf).where("content IS NOT NULL").select("id", "importance", key.alias("key"))
    old = m.where("id % 5 <> 0")
    fresh = m.where("id % 5 = 0").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("times"), F.max("importance").alias("best"))
    stored = tables.read(spark, sf, "embeddings")
    pairs = vectors.near_vectors(similarity.of_memories(stored, old), 0.45, queries=similarity.of_memories(stored, m.where("id % 5 = 0")))
    near = pairs.select(F.col("a").alias("id")).distinct().withColumn("near", F.lit(True))
    rows = fresh.join(old.select("key").distinct().withColumn("known", F.lit(True)), "key", "left").join(near, "id", "left")
    promoted = (F.col("best") >= 0.55) | ((F.col("times") >= 2) & (F.col("best") >= 0.35))
    return rows.select("id", "times", F.when(~promoted, "rejected").when(F.col("known"), "repeated").when(F.col("near"), "merged").otherwise("stored").alias("outcome"))


@query("P12_end_of_session", """WITH u AS (SELECT session_id, turn_id, content, regexp_matches(lower(content), 'important|remember|중요|기억|save|저장') OR turn_id % 4 = 0 AS worth, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS k FROM messages WHERE role = 'user'),
s AS (SELECT session_id, count(*) AS user_turns, count(*) FILTER (worth) AS facts, left(string_agg(content, ' / ' ORDER BY turn_id) FILTER (k <= 3), 500) AS summary FROM u GROUP BY 1)
SELECT session_id, t.turns, user_turns, s.summary, facts, facts > 0 AS promoted FROM s JOIN sessions t USING (session_id)""")  # fmt: skip
def end_of_session(spark, sf):
    """What a session leaves: a summary of its first three questions, the facts that say they are worth keeping (every fourth turn does), and
    whether any is promoted."""
    said = F.concat("content", F.when(F.col("turn_id") % 4 == 0, " remember").otherwise(""))
    u = tables.messages(spark, sf).where("role = 'user'").select("session_id", "turn_id", "content", (rules.worth(said) >= 0.55).alias("worth"))
    first = selection.newest(u, ["session_id"], [F.asc("turn_id")], 3).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "content"))).alias("m"))
    first = first.select("session_id", F.substring(F.array_join("m.content", " / "), 1, 500).alias("summary"))
    s = u.groupBy("session_id").agg(F.count("*").alias("user_turns"), F.count_if("worth").alias("facts")).join(first, "session_id")
    return s.join(tables.sessions(spark, sf).select("session_id", "turns"), "session_id").select("session_id", "turns", "user_turns", "summary", "facts", (F.col("facts") > 0).alias("promoted"))


@query("P16_recent_summaries", """WITH r AS (SELECT * FROM messages ORDER BY ts DESC, session_id, turn_id LIMIT 100), d AS (SELECT ts::DATE AS day, count(*) AS n FROM r GROUP BY 1 ORDER BY day DESC LIMIT 10),
l AS (SELECT row_number() OVER (ORDER BY ts DESC, session_id, turn_id) AS k, '  [' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || role || ': ' || replace(left(content, 80), chr(10), ' ') || '...' AS line FROM r ORDER BY ts DESC, session_id, turn_id LIMIT 20),
t AS (SELECT k, line, 20 * (SELECT count(*) FROM d) + sum(length(line)) OVER (ORDER BY k) AS total FROM l)
SELECT 1 AS part, row_number() OVER (ORDER BY day DESC) AS place, '  ' || day::VARCHAR || ': ' || n AS line FROM d UNION ALL SELECT 2, k, line FROM t WHERE total <= 1000
UNION ALL SELECT 3, row_number() OVER (ORDER BY md5(session_id || ':' || turn_id)), '  [' || ts::DATE::VARCHAR || '] ' || role || ': ' || replace(left(content, 80), chr(10), ' ') || '...' FROM (SELECT * FROM r WHERE ts < TIMESTAMP '2024-01-30' ORDER BY md5(session_id || ':' || turn_id) LIMIT 5)""")  # fmt: skip
def recent_summaries(spark, sf):
    """Of the last hundred messages: how many a day, the newest ones within a budget of characters, and some older ones."""
    r = graph.cut(tables.messages(spark, sf).orderBy(F.desc("ts"), "session_id", "turn_id").limit(100))
    line = F.concat(F.lit("] "), "role", F.lit(": "), F.replace(F.substring("content", 1, 80), F.lit("\n"), F.lit(" ")), F.lit("..."))
    at = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("long").alias("place")  # noqa: E731  a hundred rows
    days = r.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(10)
    newest = r.orderBy(F.desc("ts"), "session_id", "turn_id").limit(20).select(at(F.desc("ts"), "session_id", "turn_id"), F.concat(F.lit("  ["), F.date_format("ts", "yyyy-MM-dd HH:mm"), line).alias("line"))
    total = F.sum(F.char_length("line")).over(Window.orderBy("place")) + F.col("head")
    newest = newest.crossJoin(days.agg((20 * F.count("*")).alias("head"))).withColumn("total", total).where("total <= 1000")
    key = F.md5(F.concat_ws(":", "session_id", "turn_id"))
    older = r.where("ts < timestamp '2024-01-30'").orderBy(key).limit(5).select(at(key), F.concat(F.lit("  ["), F.date_format("ts", "yyyy-MM-dd"), line).alias("line"))
    first = days.select(at(F.desc("day")), F.concat(F.lit("  "), F.col("day").cast("string"), F.lit(": "), F.col("n").cast("string")).alias("line"))
    parts = [df.select(F.lit(k).alias("part"), "place", "line") for k, df in ((1, first), (2, newest), (3, older))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("J26_two_searches", """SELECT '[Web]' || chr(10) || string_agg(url, chr(10) ORDER BY page_id) AS text FROM (SELECT page_id, url FROM pages WHERE contains(lower(html), 'the') ORDER BY page_id LIMIT 3) HAVING count(*) > 0
UNION ALL SELECT '[Memory]' || chr(10) || string_agg(left(content, 100), chr(10) ORDER BY id) FROM (SELECT id, content FROM memories WHERE contains(lower(content), 'the') ORDER BY importance DESC, id LIMIT 3) HAVING count(*) > 0
UNION ALL SELECT '[None]' || chr(10) || string_agg(name, chr(10)) FROM entities WHERE name = 'nothing' HAVING count(*) > 0""")  # fmt: skip
def two_searches(spark, sf):
    """The finds of several searches, each under its label; a search without any is left out."""
    word = F.lit("the")
    web = tables.read(spark, sf, "pages").where(F.contains(F.lower("html"), word)).orderBy("page_id").limit(3).select("page_id", "url")
    known = tables.memories(spark, sf).where(F.contains(F.lower("content"), word)).orderBy(F.desc("importance"), "id").limit(3).select("id", "content")
    none = tables.entities(spark, sf).where("name = 'nothing'")
    found = [("[Web]\n", lines(web, ["page_id"], F.col("url"))), ("[Memory]\n", lines(known, ["id"], F.substring("content", 1, 100))), ("[None]\n", lines(none, ["entity_id"], F.col("name")))]
    parts = [df.select(F.concat(F.lit(label), "text").alias("text")) for label, df in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("S38_search_results", "SELECT page_id, 'Title ' || page_id AS title, url FROM pages WHERE url IS NOT NULL")
def search_results(spark, sf):
    """Titles and addresses of landed result pages; an address in the parameter of a redirect is taken out of it."""
    landed = F.concat(F.lit('<a class="result__a" href="//r.example/l/?uddg='), F.url_encode("url"), F.lit('&amp;rut=1">Title '), F.col("page_id").cast("string"), F.lit("</a>"))
    rows = tables.read(spark, sf, "pages").where("url IS NOT NULL").select("page_id", landed.alias("html"))
    href, title = F.regexp_extract("html", r'class="result__a" href="([^"]*)"', 1), F.regexp_extract("html", r">([^<]*)</a>", 1)
    inner = F.regexp_extract(href, r"[?&]uddg=([^&]*)", 1)
    return rows.select("page_id", title.alias("title"), F.when(inner != "", F.url_decode(inner)).otherwise(href).alias("url"))


@query("S39_answer_markdown", "SELECT page_id, '**Answer** ' || page_id || chr(10) || '1. [a](' || url || ')' || chr(10) || '2. [b](' || url || '#b)' AS text FROM pages WHERE url IS NOT NULL")
def answer_markdown(spark, sf):
    """A landed answer and its ranked results as Markdown."""
    result = lambda t, u: F.struct(F.lit(t).alias("title"), u.alias("url"))
    landed = F.to_json(F.struct(F.col("page_id").cast("string").alias("answer"), F.array(result("a", F.col("url")), result("b", F.concat("url", F.lit("#b")))).alias("results")))
    rows = tables.read(spark, sf, "pages").where("url IS NOT NULL").select("page_id", F.from_json(landed, "answer string, results array<struct<title:string,url:string>>").alias("j"))
    ranked = F.transform("j.results", lambda r, k: F.concat((k + 1).cast("string"), F.lit(". ["), r["title"], F.lit("]("), r["url"], F.lit(")")))
    return rows.select("page_id", F.concat(F.lit("**Answer** "), "j.answer", F.lit("\n"), F.array_join(ranked, "\n")).alias("text"))


@query("S35_persona", "SELECT n_nationkey AS id, n_name AS name, (n_nationkey % 10) / 10.0::DOUBLE AS confidence, n_regionkey + 1 AS version FROM nation")
def persona(spark, sf):
    """A document with nested parts, read, its version raised, written and read again."""
    schema = "name string, traits struct<tone:string,confidence:double>, version long"
    first = F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.lit("calm").alias("tone"), (F.col("n_nationkey") % 10 / 10).alias("confidence")).alias("traits"), F.col("n_regionkey").alias("version")))
    rows = tables.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.from_json(first, schema).alias("p"))
    again = F.from_json(F.to_json(F.col("p").withField("version", F.col("p.version") + 1)), schema)
    return rows.select("id", again.alias("p")).select("id", "p.name", F.col("p.traits.confidence").alias("confidence"), "p.version")


@query("T16_fan_out", "SELECT 'archive' AS sink, count(*) AS n FROM messages UNION ALL SELECT 'events', count(*) FROM messages WHERE role = 'user' UNION ALL SELECT 'working', count(*) FROM (SELECT 1 FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) <= 4)")
def fan_out(spark, sf):
    """One batch of messages for three sinks: all to the archive, users' as events, the last four of a session to the working buffer."""
    m = tables.messages(spark, sf)
    sinks = {"archive": m, "events": m.where("role = 'user'"), "working": selection.newest(m, ["session_id"], [F.desc("turn_id")], 4)}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("sink"), "n") for name, df in sinks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("P18_after_turn", f"SELECT session_id, turn_id, sha256(content) AS key, regexp_matches(content, {quoted(rules.any_of(rules.LOG_MARKERS))}) AS noise, ((turn_id % 3) + 1)::INT AS accesses FROM messages WHERE role = 'assistant' AND content IS NOT NULL")
def after_turn(spark, sf):
    """What is kept of an answer: its key, whether it is noise, and the accesses of the memory that it used."""
    rows = tables.messages(spark, sf).where("role = 'assistant' AND content IS NOT NULL")
    return rows.select("session_id", "turn_id", F.sha2("content", 256).alias("key"), rules.is_noise(F.col("content")).alias("noise"), (F.col("turn_id") % 3 + 1).cast("int").alias("accesses"))
