"""Queries over the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import graph
from tidepool.plans.registry import query
from tidepool.sources import tables

EDGES = "edges AS (SELECT source_id AS a, target_id AS b FROM relations UNION SELECT target_id, source_id FROM relations)"
STARTS = ("s:1", "s:7", "n:3")


def levels(starts: str, depth: int) -> str:
    """SQL: tables l0 to l<depth> of (start, node, path), the new nodes of each level with the least of their shortest paths."""
    out = [f"l0 AS (SELECT start, start AS node, [start] AS path FROM ({starts}))"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT start, node FROM l{j}" for j in range(k))
        out.append(f"l{k} AS MATERIALIZED (SELECT start, b AS node, min(list_append(path, b)) AS path FROM l{k - 1} JOIN edges ON a = node WHERE (start, b) NOT IN ({seen}) GROUP BY 1, 2)")
    return ", ".join(out)


def reached(depth: int) -> str:
    return " UNION ALL ".join(f"SELECT start, node, {k}::INT AS distance, path FROM l{k}" for k in range(depth + 1))


def starts(spark):
    return spark.createDataFrame([(s,) for s in STARTS], "start string")


def labels(rounds: int = 10) -> str:
    """SQL: l<rounds> has the least node that is within so many steps of each."""
    out = ["l1 AS (SELECT a AS node, least(a, min(b)) AS c FROM edges GROUP BY a)"]
    out += [f"l{k} AS MATERIALIZED (SELECT x.node, least(x.c, min(y.c)) AS c FROM l{k - 1} x JOIN edges ON a = x.node JOIN l{k - 1} y ON y.node = b GROUP BY x.node, x.c)" for k in range(2, rounds + 1)]
    return ", ".join(out)


_STARTS = f"SELECT unnest([{', '.join(repr(s) for s in STARTS)}]) AS start"


@query("G01_neighbours", f"WITH {EDGES}, {levels(_STARTS, 2)} SELECT start, node, distance FROM ({reached(2)})")
def neighbours(spark, sf):
    return graph.neighbours(tables.relations(spark, sf), starts(spark), 2)


@query("G02_neighbours_without_start", f"WITH {EDGES}, {levels(chr(39).join(('SELECT ', 'n:3', ' AS start')), 2)} SELECT node FROM ({reached(2)}) WHERE node <> start")
def neighbours_without_start(spark, sf):
    return graph.neighbours(tables.relations(spark, sf), spark.createDataFrame([("n:3",)], "start string"), 2).where("node <> start").select("node")


@query("G03_recursive_neighbours", f"WITH {EDGES}, {levels(chr(39).join(('SELECT ', 's:4', ' AS start')), 3)} SELECT node, distance FROM ({reached(3)})")
def recursive_neighbours(spark, sf):
    # level by level instead of recursion over paths, whose number explodes on dense graphs
    return graph.neighbours(tables.relations(spark, sf), spark.createDataFrame([("s:4",)], "start string"), 3).select("node", "distance")


@query("G04_components", f"WITH {EDGES}, {labels()} SELECT node, c AS component FROM l10")
def components(spark, sf):
    return graph.components(tables.relations(spark, sf))


@query("A26_component_sizes", f"WITH {EDGES}, {labels()} SELECT c AS component, count(*) AS n FROM l10 GROUP BY 1")
def component_sizes(spark, sf):
    return graph.components(tables.relations(spark, sf)).groupBy("component").agg(F.count("*").alias("n"))


_GOALS = ("s:2", "s:3", "r:1", "n:5")
_PATHS = f"WITH {EDGES}, {levels(chr(39).join(('SELECT ', 's:1', ' AS start')), 3)} SELECT start AS source, node AS target, distance, array_to_string(path, '>') AS path FROM ({reached(3)}) WHERE node IN {_GOALS}"


@query("G05_shortest_path", _PATHS)
def shortest_path(spark, sf):
    pairs = spark.createDataFrame([("s:1", t) for t in _GOALS], "source string, target string")
    return graph.shortest_paths(tables.relations(spark, sf), pairs, 3).withColumn("path", F.array_join("path", ">"))


@query("G06_path_by_levels", _PATHS.replace(str(_GOALS), "('p:3')"))
def path_by_levels(spark, sf):
    pairs = spark.createDataFrame([("s:1", "p:3")], "source string, target string")
    return graph.shortest_paths(tables.relations(spark, sf), pairs, 3).withColumn("path", F.array_join("path", ">"))


@query("G07_traversal", """
WITH best AS (SELECT source_id AS a, target_id AS b, weight AS w FROM relations WHERE weight >= 0.04 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id, relation_type) <= 10),
l1 AS (SELECT b AS node, max(w) AS weight FROM best WHERE a = 's:1' GROUP BY 1), l2 AS (SELECT b AS node, max(weight * w) AS weight FROM l1 JOIN best ON a = node WHERE b <> 's:1' AND b NOT IN (SELECT node FROM l1) GROUP BY 1)
SELECT 's:1' AS start, node, round(weight, 6) AS weight, 1 AS distance FROM l1 UNION ALL SELECT 's:1', node, round(weight, 6), 2 FROM l2""")  # fmt: skip
def traversal(spark, sf):
    found = graph.traverse(tables.relations(spark, sf), spark.createDataFrame([("s:1",)], "start string"), 2, 0.04)
    return found.select("start", "node", F.round("weight", 6).alias("weight"), "distance")


@query("G10_relation_upsert", "SELECT source_id, target_id, relation_type, round(weight + CASE WHEN relation_type = 'part_of' THEN 0.1 ELSE 0 END, 6) AS weight FROM relations")
def relation_upsert(spark, sf):
    rows = tables.relations(spark, sf)
    return graph.upsert_relations(rows, rows.where("relation_type = 'part_of'")).select("source_id", "target_id", "relation_type", F.round("weight", 6).alias("weight"))


@query("G11_relations_of", "SELECT source_id, target_id, weight FROM relations WHERE source_id = 'n:3' OR target_id = 'n:3' ORDER BY weight DESC, source_id, target_id")
def relations_of(spark, sf):
    return tables.relations(spark, sf).where("source_id = 'n:3' OR target_id = 'n:3'").select("source_id", "target_id", "weight")


@query("D13_relation_weight", """
WITH p AS (SELECT source_id, count(DISTINCT target_id) AS partners FROM relations GROUP BY 1), q AS (SELECT source_id, target_id, count(*) AS pair FROM relations GROUP BY 1, 2),
w AS (SELECT r.*, least(1.0, greatest(0.0, 0.7 * q.pair / coalesce(e.mentions, 1)::DOUBLE * ln((SELECT count(*) FROM entities) / (1.0 + p.partners)) + 0.3 * r.weight)) AS new
  FROM relations r JOIN p USING (source_id) JOIN q USING (source_id, target_id) LEFT JOIN entities e ON e.entity_id = r.source_id)
SELECT source_id, target_id, relation_type, round(CASE WHEN abs(new - weight) > 0.001 THEN new ELSE weight END, 6) AS weight FROM w""")  # fmt: skip
def relation_weight(spark, sf):
    return graph.relation_weights(tables.relations(spark, sf), tables.entities(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("D14_weight_decay", "SELECT source_id, target_id, round(weight * 0.9 ** (14 / 7.0), 6) AS weight FROM relations WHERE weight * 0.9 ** (14 / 7.0) >= 0.1")
def weight_decay(spark, sf):
    faded = F.col("weight") * F.pow(F.lit(0.9), F.lit(14) / 7.0)
    return tables.relations(spark, sf).where(faded >= 0.1).select("source_id", "target_id", F.round(faded, 6).alias("weight"))


@query("J03_orphan_relations", "SELECT source_id, target_id FROM relations WHERE source_id NOT IN (SELECT entity_id FROM entities WHERE mentions > 2) OR target_id NOT IN (SELECT entity_id FROM entities WHERE mentions > 2)")
def orphan_relations(spark, sf):
    known = tables.entities(spark, sf).where("mentions > 2").select("entity_id")
    has = lambda end: known.select(F.col("entity_id").alias(end), F.lit(True).alias(f"has_{end}"))
    rows = tables.relations(spark, sf).join(has("source_id"), "source_id", "left").join(has("target_id"), "target_id", "left")
    return rows.where("has_source_id IS NULL OR has_target_id IS NULL").select("source_id", "target_id")


@query("J04_cascade_delete", "SELECT source_id, target_id FROM relations WHERE source_id NOT IN (SELECT entity_id FROM entities WHERE mentions < 3) AND target_id NOT IN (SELECT entity_id FROM entities WHERE mentions < 3)")
def cascade_delete(spark, sf):
    stale = tables.entities(spark, sf).where("mentions < 3").select("entity_id")
    rows = tables.relations(spark, sf)
    for end in ("source_id", "target_id"):
        rows = rows.join(stale.select(F.col("entity_id").alias(end)), end, "left_anti")
    return rows.select("source_id", "target_id")


@query("J13_remap_relations", "WITH m AS (SELECT 's:' || s_suppkey AS old, 's:' || (s_suppkey - s_suppkey % 2) AS new FROM supplier), r AS (SELECT coalesce(a.new, source_id) AS source_id, coalesce(b.new, target_id) AS target_id, relation_type, weight FROM relations LEFT JOIN m a ON a.old = source_id LEFT JOIN m b ON b.old = target_id) SELECT source_id, target_id, relation_type, max(weight) AS weight FROM r WHERE source_id <> target_id GROUP BY 1, 2, 3")
def remap_relations(spark, sf):
    key = F.col("s_suppkey")
    mapping = tables.read(spark, sf, "supplier").select(F.concat(F.lit("s:"), key).alias("old"), F.concat(F.lit("s:"), key - key % 2).alias("new"))
    return graph.merge_entities(tables.relations(spark, sf), mapping)


@query("J16_merge_extractions", "WITH a AS (SELECT lower(name) AS k, entity_type FROM entities WHERE entity_type = 'nation'), b AS (SELECT lower(name) AS k, 'place' AS entity_type FROM entities WHERE entity_type IN ('nation', 'region') AND mentions > 3) SELECT k, coalesce(b.entity_type, a.entity_type) AS entity_type, CASE WHEN a.k IS NULL THEN 'second' WHEN b.k IS NULL THEN 'first' ELSE 'merged' END AS origin FROM a FULL JOIN b USING (k)")
def merge_extractions(spark, sf):
    rows = tables.entities(spark, sf)
    a = rows.where("entity_type = 'nation'").select(F.lower("name").alias("k"), F.col("entity_type").alias("a"))
    b = rows.where("entity_type IN ('nation', 'region') AND mentions > 3").select(F.lower("name").alias("k"), F.lit("place").alias("b"))
    origin = F.when(F.col("a").isNull(), "second").when(F.col("b").isNull(), "first").otherwise("merged")
    return a.join(b, "k", "full").select("k", F.coalesce("b", "a").alias("entity_type"), origin.alias("origin"))


@query("J17_edge_names", "SELECT a.name AS source, b.name AS target, r.relation_type FROM relations r JOIN entities a ON a.entity_id = r.source_id JOIN entities b ON b.entity_id = r.target_id")
def edge_names(spark, sf):
    names = tables.entities(spark, sf)
    a, b = names.select(F.col("entity_id").alias("source_id"), F.col("name").alias("source")), names.select(F.col("entity_id").alias("target_id"), F.col("name").alias("target"))
    return tables.relations(spark, sf).join(a, "source_id").join(b, "target_id").select("source", "target", "relation_type")


@query("U07_dead_entities", "SELECT entity_id FROM entities e WHERE mentions <= 1 AND last_accessed < TIMESTAMP '2024-02-01' - INTERVAL 20 DAY AND entity_id NOT IN (SELECT source_id FROM relations WHERE weight >= 0.3 UNION ALL SELECT target_id FROM relations WHERE weight >= 0.3)")
def dead_entities(spark, sf):
    # relations that have faded are gone before
    ends = tables.relations(spark, sf).where("weight >= 0.3").select(F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    old = tables.entities(spark, sf).where("mentions <= 1").where(F.col("last_accessed") < tables.now() - F.expr("interval 20 days"))
    return old.join(ends, "entity_id", "left_anti").select("entity_id")


@query("G08_entity_upsert", "SELECT entity_id, sum(mentions)::BIGINT AS mentions, max(last_accessed) AS last_accessed FROM (SELECT entity_id, mentions, last_accessed FROM entities UNION ALL SELECT entity_id, 1, TIMESTAMP '2024-02-01' FROM entities WHERE mentions = 4) GROUP BY 1")
def entity_upsert(spark, sf):
    rows = tables.entities(spark, sf).select("entity_id", "mentions", "last_accessed")
    again = rows.where("mentions = 4").select("entity_id", F.lit(1).cast("long").alias("mentions"), tables.now().alias("last_accessed"))
    return rows.unionByName(again).groupBy("entity_id").agg(F.sum("mentions").alias("mentions"), F.max("last_accessed").alias("last_accessed"))
