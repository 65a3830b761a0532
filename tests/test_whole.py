"""Queries over whole tables against plain Python on the smallest tables."""

from collections import Counter, defaultdict

import pytest

from tidepool.plans import registry
from tidepool.sources import tables

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return [tuple(r) for r in registry.QUERIES[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def edges(spark):
    out = defaultdict(set)
    for r in tables.relations(spark, SF).select("source_id", "target_id").collect():
        if r[0] != r[1]:
            out[r[0]].add(r[1])
            out[r[1]].add(r[0])
    return out


def levels(edges, start, depth=10**9):
    seen, now = {start: 0}, {start}
    while now and depth > seen[next(iter(now))]:
        at = seen[next(iter(now))] + 1
        now = {b for a in now for b in edges[a]} - set(seen)
        seen |= {n: at for n in now}
    return seen


def test_graph_over_all_relations(spark, edges):
    assert sorted(rows_of(spark, "G01_neighbours")) == sorted((s, n, d) for s in ("s:1", "s:7", "n:3") for n, d in levels(edges, s, 2).items())
    assert sorted(rows_of(spark, "G02_neighbours_without_start")) == sorted((n,) for n, d in levels(edges, "n:3", 2).items() if d)
    assert sorted(rows_of(spark, "G03_recursive_neighbours")) == sorted(levels(edges, "s:4", 3).items())
    least = {}
    for n in sorted(edges):
        if n not in least:
            least |= {m: n for m in levels(edges, n)}
    assert dict(rows_of(spark, "G04_components")) == least
    assert dict(rows_of(spark, "A26_component_sizes")) == dict(Counter(least.values()))
    far = levels(edges, "s:1", 3)
    paths = rows_of(spark, "G05_shortest_path")
    assert {t: d for _, t, d, _ in paths} == {t: far[t] for t in ("s:2", "s:3", "r:1", "n:5") if t in far}
    for s, t, d, path in paths:
        steps = path.split(">")
        assert (steps[0], steps[-1], len(steps)) == (s, t, d + 1) and all(b in edges[a] for a, b in zip(steps, steps[1:], strict=False))


def test_paths_of_pairs_use_all_relations(spark, edges):
    near = sorted(levels(edges, "s:1", 1))
    pairs = sorted((a, b) for a in near for b in near if a < b)[:10]
    found = {(r[0], r[1]): r[2] for r in rows_of(spark, "J24_path_pairs")}
    assert found == {(a, b): levels(edges, a, 3)[b] for a, b in pairs if b in levels(edges, a, 3)}


def test_edges_are_all_there(spark):
    relations = [tuple(r) for r in tables.relations(spark, SF).select("source_id", "target_id", "relation_type").collect()]
    names = {r[0]: r[1] for r in tables.entities(spark, SF).select("entity_id", "name").collect()}
    assert sorted(rows_of(spark, "J17_edge_names")) == sorted((names[a], names[b], t) for a, b, t in relations if a in names and b in names)
    assert sorted(rows_of(spark, "S21_graph_json")) == sorted((f'["{a}|x","{b}"]', f"{a}|x", b) for a, b, _ in relations)


def test_keyword_query_uses_all_relations(spark, edges):
    entities = [tuple(r) for r in tables.entities(spark, SF).select("entity_id", "mentions", "name").collect()]
    seeds = [e[0] for w in ("trade", "asia", "with", "nation_3", "and", "nation_7") for e in sorted((e for e in entities if w in e[2].lower()), key=lambda e: (-e[1], e[0]))[:2]][:3]
    around = {n for s in seeds for n in levels(edges, s, 2)}
    want = sorted(((e[0], e[1]) for e in entities if e[0] in around), key=lambda e: (-e[1], e[0]))[:5]
    assert sorted(rows_of(spark, "G12_keyword_query")) == sorted(want)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_every_row_is_there(spark):
    docs = {r.doc_id: r for r in tables.read(spark, SF, "documents").collect()}
    assert {r[0]: r[1] for r in rows_of(spark, "F15_emoji")} == {i: f"{r.text} " for i, r in docs.items()}
    assert {r[0] for r in rows_of(spark, "D22_text_ratio")} == {i for i in docs if i + 1 in docs}
    assert {r[0] for r in rows_of(spark, "X15_channel_chunks")} == {i for i, r in docs.items() if r.text}
    calls = tables.interactions(spark, SF).select("id", "model", "latency_ms").collect()
    assert sorted(rows_of(spark, "S47_log_lines")) == sorted((r[0], r[1], str(int(r[2]))) for r in calls)
    ids = sorted((r[0] % 5, r[0]) for r in tables.memories(spark, SF).select("id").collect())
    assert sorted(rows_of(spark, "L09_section_order")) == sorted((i, k + 1) for k, (_, i) in enumerate(ids))
    found = dict(rows_of(spark, "D23_byte_levenshtein"))
    assert set(found) == set(docs)
    some = sorted(docs, key=lambda i: (all(ord(c) < 128 for c in docs[i].text), len(docs[i].text), i))[:4]
    assert all(found[i] == distance(docs[i].text.encode(), (docs[i].lang + docs[i].source + docs[i].text).encode()) for i in some)


def test_a_context_is_one_text_of_all_its_lines(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}" * 70) for t in range(7)] + [(2, 0, "user", None), (3, 1, "user", None), (3, 0, "assistant", "b")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["session_id"]: r["context"] for r in registry.QUERIES["W08_progressive_context"](spark, str(tmp_path)).collect()}
    cut = [50, 30, 50, 70, 70, 70, 70]
    assert found == {1: "\n".join(f"{r[2]}: {r[3][:n]}" for r, n in zip(rows, cut, strict=False)), 2: None, 3: "assistant: b"}
