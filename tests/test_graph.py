"""Paths and components against plain Python on random graphs, chains and stars."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidepool.functions import texts
from tidepool.operators import graph

EDGES = "source_id string, target_id string"


def around(edges):
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def best_path(near, a, b, depth):
    """The least of the shortest paths, level by level."""
    level, seen = {a: [a]}, {a}
    for _ in range(depth + 1):
        if b in level:
            return level[b]
        step = {}
        for x, path in level.items():
            for y in near[x] - seen:
                step[y] = min(step.get(y, path + [y]), path + [y])
        seen |= set(step)
        level = step
    return None


@pytest.mark.parametrize("seed, n, m, depth", [(1, 30, 45, 4), (2, 60, 70, 6), (3, 20, 60, 3), (4, 40, 38, 1)])
def test_paths_are_the_least(spark, seed, n, m, depth):
    rng = random.Random(seed)
    names = [f"n{k:02d}" for k in range(n)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(m)] + [("p", "q"), ("q", "p"), ("r", "r")]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(40)] + [("p", "q"), ("p", "p"), ("r", "r"), ("p", "n01"), ("nowhere", "n01"), ("p", "q")]
    got = graph.shortest_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "source string, target string"), depth).collect()
    near = around(edges)
    want = {(a, b): best_path(near, a, b, depth) for a, b in pairs}
    assert {(r.source, r.target): r.path for r in got} == {p: x for p, x in want.items() if x}
    assert len(got) == len({tuple(r[:2]) for r in got}) and all(r.distance == len(r.path) - 1 for r in got)


def test_paths_search_from_both_ends(spark, monkeypatch):
    # a tree of ten branches a node: from one end alone, a path of four steps reaches 10,000 nodes
    edges = [("t", f"t{a}") for a in range(10)]
    for _ in range(3):
        edges += [(x, f"{x}{a}") for x in {b for _, b in edges} - {a for a, _ in edges} for a in range(10)]
    grown, rows = graph._grown, []

    def counted(*args):
        out = grown(*args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "_grown", counted)
    got = graph.shortest_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("t", "t1234")], "source string, target string"), 6).collect()
    assert got[0].path == ["t", "t1", "t12", "t123", "t1234"]
    assert sum(rows) < 150


def roots(edges):
    near, out = around(edges), {}
    for a in sorted(near):
        todo = [a] if a not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = a
                todo += near[x]
    return out


@pytest.mark.parametrize("hub", [3, 10_000])
@pytest.mark.parametrize("kind", ["random", "chain", "star", "two"])
def test_components(spark, monkeypatch, hub, kind):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(7)
    edges = {
        "random": [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(60)] + [("x", "x")],
        "chain": [(f"n{k:03d}", f"n{(k * 37 + 37) % 101:03d}") for k in (j * 37 % 101 for j in range(100))],
        "star": [("m", f"{rng.choice('az')}{k}") for k in range(50)],
        "two": [(f"a{k}", f"a{k // 2}") for k in range(1, 40)] + [(f"b{k}", f"b{k + 1}") for k in range(20)],
    }[kind]
    assert dict(map(tuple, graph.components(spark.createDataFrame(edges, EDGES)).collect())) == roots(edges)


def test_graphs_of_nothing(spark):
    none = spark.createDataFrame([], EDGES)
    assert graph.components(none).collect() == []
    assert graph.shortest_paths(none, spark.createDataFrame([("a", "b")], "source string, target string"), 3).collect() == []
    assert [tuple(r) for r in graph.neighbours(none, spark.createDataFrame([("a",), ("a",)], "start string"), 2).collect()] == [("a", "a", 0)]


def test_a_graph_cleaned_up(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    rows = [("a", "Green Tea", 1, day(1)), ("b", "green_tea", 2, day(20)), ("c", "Old", 1, day(1)), ("d", "old but used", 1, day(1)), ("e", "new", 1, day(31)), ("f", "often", 5, day(1)), ("g", None, 1, None)]
    entities = spark.createDataFrame(rows, "entity_id string, name string, mentions long, last_accessed string").withColumn("last_accessed", F.col("last_accessed").cast("timestamp"))
    relations = spark.createDataFrame([("a", "b", "x", 0.9), ("b", "f", "x", 0.4), ("a", "f", "x", 0.6), ("d", "f", "x", 0.5), ("c", "f", "x", 0.1), ("f", "zz", "x", 0.9)], "source_id string, target_id string, relation_type string, weight double")
    alive, left = graph.optimised(entities, relations, texts.name_key(F.col("name")), now)
    assert sorted((r.entity_id, r.mentions) for r in alive.collect()) == [("a", 3), ("d", 1), ("e", 1), ("f", 5), ("g", 1)]
    want = lambda pair, mentions, partners, old: min(1.0, max(0.0, 0.7 * pair / mentions * math.log(5 / (1 + partners)) + 0.3 * old))
    assert {(r.source_id, r.target_id): round(r.weight, 9) for r in left.collect()} == {("a", "f"): round(want(1, 3, 1, 0.6), 9), ("d", "f"): round(want(1, 1, 1, 0.5), 9)}
