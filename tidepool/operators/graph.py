"""Graph operators over vertex and edge tables, level by level, with edges made symmetric once."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share. Without one, only a session of one machine goes on."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidepool-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; Spark removes it later if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a frontier that are broadcast; more are joined by a shuffle.
FEW = 100_000


def _step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    few = frontier.limit(FEW + 1).count() <= FEW
    return edges.join(F.broadcast(frontier) if few else frontier, F.col("node") == F.col("a"))


def symmetric(relations: DataFrame) -> DataFrame:
    """(a, b) in both directions, once each, without loops."""
    return _both(relations).distinct()


def _both(relations: DataFrame) -> DataFrame:
    """(a, b) in both directions, as they come from the table, without loops."""
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b"))))
    return relations.where("source_id <> target_id").select(ends.alias("e")).select("e.*")


def _one_way(relations: DataFrame) -> DataFrame:
    """The relations' ends, computed once for many passes over them: neither copied nor sorted, only kept."""
    return cut(relations.select("source_id", "target_id").where("source_id <> target_id"))


def neighbours(relations: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, distance) of nodes within ``depth`` of each of ``starts`` (one column, start), the start itself included.

    Each level is one pass over the relations, whose both ends meet the frontier; no copy of them is sorted or written for one or two levels."""
    edges = _both(relations if depth <= 2 else _one_way(relations))
    seen = starts.select("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("distance"))
    frontier = seen
    for level in range(1, depth + 1):
        step = _step(frontier, edges).select("start", F.col("b").alias("node")).distinct()
        frontier = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


def _grown(edges: DataFrame, frontier: DataFrame, seen: DataFrame, key: str, level: int) -> DataFrame:
    """(key, node, d, next) of the nodes a step further, with the least of the neighbours that they were reached from."""
    step = _step(frontier.select(key, "node"), edges).groupBy(key, F.col("b").alias("node")).agg(F.min("node").alias("next"))
    return cut(step.join(seen.select(key, "node"), [key, "node"], "left_anti").select(key, "node", F.lit(level).alias("d"), "next"))


def shortest_paths(relations: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(source, target, distance, path) of the shortest path of each pair within ``depth``; of equal ones the least by its nodes.

    Both ends search by turns until they meet, so frontiers are those of half the distance. A reached node is one row with one link: behind
    the meeting, its least neighbour that is nearer to the target; before it, nodes that lead to the meeting are found from there backwards, and
    get the same link. Only what is returned has a path: each pair follows its links from the source."""
    edges = _both(_one_way(relations))
    goals = cut(pairs.select("source", "target").distinct())
    ends = lambda key: goals.select(key).distinct().select(key, F.col(key).alias("node"), F.lit(0).alias("d"), F.lit(None).cast(dict(goals.dtypes)[key]).alias("next"))
    ahead, behind = ends("source"), ends("target")
    frontier, back, k, j, met = ahead, behind, 0, 0, None
    left = goals
    while True:
        here = left.join(ahead.where(F.col("d") == k).select("source", "node"), "source").join(behind.where(F.col("d") == j).select("target", "node"), ["target", "node"])
        found = cut(here.select("source", "target", "node", F.lit(k).alias("d")))
        met = found if met is None else met.unionByName(found)
        left = cut(left.join(found.select("source", "target").distinct(), ["source", "target"], "left_anti"))
        if k + j == depth or left.isEmpty():
            break
        if k <= j:
            k += 1
            frontier = _grown(edges, frontier.join(left.select("source").distinct(), "source", "left_semi"), ahead, "source", k)
            ahead = ahead.unionByName(frontier)
        else:
            j += 1
            back = _grown(edges, back.join(left.select("target").distinct(), "target", "left_semi"), behind, "target", j)
            behind = behind.unionByName(back)
    on = met.withColumn("next", F.lit(None).cast(dict(goals.dtypes)["target"]))
    for level in range(k - 1, -1, -1):
        step = _step(on.where(F.col("d") == level + 1).select("source", "target", "node"), edges).groupBy("source", "target", F.col("b").alias("x")).agg(F.min("node").alias("next"))
        step = step.join(ahead.where(F.col("d") == level).select("source", F.col("node").alias("x")), ["source", "x"])
        on = on.unionByName(cut(step.select("source", "target", F.col("x").alias("node"), F.lit(level).alias("d"), "next")))
    links = on.where("next IS NOT NULL").select("source", "target", "node", F.col("next").alias("there"))
    onward = behind.where("next IS NOT NULL").select("target", "node", F.col("next").alias("onward"))
    way = met.select("source", "target").distinct().select("source", "target", F.col("source").alias("node"), F.array("source").alias("path"))
    for _ in range(k + j):
        step = way.join(links, ["source", "target", "node"], "left").join(onward, ["target", "node"], "left")
        step = step.withColumn("to", F.when(F.col("node") != F.col("target"), F.coalesce("there", "onward")))
        way = step.select("source", "target", F.coalesce("to", "node").alias("node"), F.when(F.col("to").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("to"))).alias("path"))
    return way.select("source", "target", (F.size("path") - 1).alias("distance"), "path")


#: Nodes of more edges are hubs: their least neighbours are broadcast, if there are no more of them than FEW.
HUB = 10_000


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): edges with the least v of all edges of u. A hub's edges don't meet in one task: what they have in common is broadcast, and how many
    hubs there may be follows from the number of edges."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    hubs = least.where(F.col("n") > HUB).select("u", "m")
    if not 0 < hubs.limit(FEW + 1).count() <= FEW:
        return edges.join(least.select("u", "m"), "u")
    marked = edges.join(F.broadcast(hubs), "u", "left")
    rest = marked.where("m IS NULL").drop("m").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    return marked.where("m IS NOT NULL").unionByName(rest)


def components(relations: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached.

    Edges are turned into stars: by turns, each node hands its least neighbour to its greater neighbours, and to its smaller ones, until every
    edge leads to the least node of its component. Long chains end in few rounds, no join is on the label of a component (a hub's least
    neighbour is broadcast), and only counts come to the driver."""
    edges = cut(relations.where("source_id <> target_id").select(F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v")).distinct())
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = None
    while before != (now := state(edges)):
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _with_least(cut(large))
        pairs = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = cut(small.select(pairs.alias("e")).select("e.*").where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def traverse(relations: DataFrame, starts: DataFrame, depth: int = 2, least: float = 0.1, per_node: int = 10) -> DataFrame:
    """(start, node, distance, weight): along the best ``per_node`` outgoing edges of each node with at least a weight; of the ways to
    a node the shortest counts, then the heaviest product of weights."""
    w = Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id", "relation_type")
    best = relations.where(F.col("weight") >= least).withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_node).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("weight").alias("w"))
    frontier = starts.select("start", F.col("start").alias("node"), F.lit(1.0).alias("weight"))
    seen = frontier.withColumn("distance", F.lit(0))
    for level in range(1, depth + 1):
        step = frontier.join(best, F.col("node") == F.col("a")).groupBy("start", F.col("b").alias("node")).agg(F.max(F.col("weight") * F.col("w")).alias("weight"))
        frontier = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen = seen.unionByName(frontier.withColumn("distance", F.lit(level)))
    return seen.where("distance > 0")


def relation_weights(relations: DataFrame, entities: DataFrame, least_change: float = 0.001) -> DataFrame:
    """(source_id, target_id, relation_type, weight) by how particular a relation is for its source: the share of the source's mentions
    that its pair has, times the logarithm of how few partners it has, and a part of the old weight."""
    n = entities.agg(F.count("*").alias("n"))
    pairs = relations.groupBy("source_id", "target_id").agg(F.count("*").alias("pair"), F.collect_list(F.struct("relation_type", "weight")).alias("r"))  # the relations of two entities
    pairs = pairs.withColumn("partners", F.count("*").over(Window.partitionBy("source_id")))
    rows = pairs.join(entities.select(F.col("entity_id").alias("source_id"), "mentions"), "source_id", "left").crossJoin(F.broadcast(n))
    rows = rows.select("*", F.explode("r").alias("one")).select("source_id", "target_id", "one.relation_type", "one.weight", "pair", "partners", "mentions", "n")
    rare = F.col("pair") / F.coalesce("mentions", F.lit(1)) * F.log(F.col("n") / (1.0 + F.col("partners")))
    new = F.least(F.greatest(0.7 * rare + 0.3 * F.col("weight"), F.lit(0.0)), F.lit(1.0))
    return rows.select("source_id", "target_id", "relation_type", F.when(F.abs(new - F.col("weight")) > least_change, new).otherwise(F.col("weight")).alias("weight"))


def merge_entities(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations with both ends mapped (old, new), loops dropped, and of equal ones the heaviest kept."""
    m = mapping.select("old", "new")
    rows = relations.join(m.withColumnsRenamed({"old": "source_id", "new": "_s"}), "source_id", "left").join(m.withColumnsRenamed({"old": "target_id", "new": "_t"}), "target_id", "left")
    rows = rows.select(F.coalesce("_s", "source_id").alias("source_id"), F.coalesce("_t", "target_id").alias("target_id"), "relation_type", "weight").where("source_id <> target_id")
    return rows.groupBy("source_id", "target_id", "relation_type").agg(F.max("weight").alias("weight"))


def optimised(entities: DataFrame, relations: DataFrame, key: Column, now: Column, days: int = 20, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) after a clean-up: entities of one ``key`` become that of the least id, with all their mentions and the latest access; relations
    are mapped to it, loops and repetitions dropped (the heaviest stays); entities of one mention at most that weren't used for so many days and
    have no relation of ``least`` weight go; so do relations with an end that isn't there; the rest is weighed anew. Entities without key stay."""
    keyed = entities.withColumn("_key", key)
    first = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.min("entity_id").alias("new"))
    mapping = cut(keyed.join(first, "_key").where("entity_id <> new").select(F.col("entity_id").alias("old"), "new"))
    renamed = entities.join(mapping, F.col("entity_id") == F.col("old"), "left").withColumn("entity_id", F.coalesce("new", "entity_id"))
    merged = renamed.groupBy("entity_id").agg(F.sum("mentions").alias("mentions"), F.max("last_accessed").alias("last_accessed"))
    mapped = cut(merge_entities(relations, mapping))
    ends = mapped.where(F.col("weight") >= least).select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).distinct().withColumn("used", F.lit(True))
    dead = (F.col("mentions") <= 1) & (F.col("last_accessed") < now - F.make_interval(days=F.lit(days))) & F.col("used").isNull()
    alive = cut(merged.join(ends, "entity_id", "left").where(~F.coalesce(dead, F.lit(False))).drop("used"))
    for end in ("source_id", "target_id"):
        mapped = mapped.join(alive.select(F.col("entity_id").alias(end)), end, "left_semi")
    return alive, relation_weights(mapped, alive)


def upsert_relations(old: DataFrame, new: DataFrame, step: float = 0.1) -> DataFrame:
    """A relation that comes again gains ``step`` each time over its first weight."""
    rows = old.select("source_id", "target_id", "relation_type", "weight", F.lit(0).alias("again")).unionByName(new.select("source_id", "target_id", "relation_type", "weight", F.lit(1).alias("again")))
    keyed = rows.groupBy("source_id", "target_id", "relation_type").agg(F.min(F.struct("again", "weight"))["weight"].alias("first"), F.count("*").alias("n"))
    return keyed.select("source_id", "target_id", "relation_type", (F.col("first") + step * (F.col("n") - 1)).alias("weight"))


def keyword_query(entities: DataFrame, relations: DataFrame, words: list[str], depth: int = 2, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) around the words of a question: two matches a word by mentions, three seeds, their neighbours, of which the
    ``most`` mentioned stay (then by id), and ten relations of these."""
    asked = [w.lower() for w in words if len(w) > 2]
    hit = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(w).alias("word")) for k, w in enumerate(asked)]), lambda w: F.contains(F.lower("name"), w["word"])))
    found = entities.select("entity_id", "mentions", hit.alias("w"))
    rank = F.row_number().over(Window.partitionBy("w.place").orderBy(F.desc("mentions"), "entity_id"))
    seeds = found.withColumn("k", rank).where("k <= 2").orderBy("w.place", "k").limit(3).select(F.col("entity_id").alias("start")).distinct()
    around = neighbours(relations, seeds, depth).select(F.col("node").alias("entity_id")).distinct()
    kept = cut(entities.join(around, "entity_id").orderBy(F.desc("mentions"), "entity_id").limit(most))
    ends = F.broadcast(kept.select(F.col("entity_id").alias("e")))  # ``most`` rows
    near = relations.join(ends, (F.col("source_id") == F.col("e")) | (F.col("target_id") == F.col("e")), "left_semi")
    return kept, near.orderBy(F.desc("weight"), "source_id", "target_id").limit(10)
