"""Similarity joins against all pairs of small tables, and how many rows they make."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import scores
from tidepool.operators import similarity, vectors


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def by_hand(rows, least):
    out = []
    for k, (i, a, p) in enumerate(rows):
        for j, b, q in rows[k + 1 :]:
            if a is None or b is None or p != q:
                continue
            x, y = a.encode(), b.encode()
            s = 1.0 if x == y else 1.0 - distance(x, y) / max(len(x), len(y))
            if s >= least:
                out.append((min(i, j), max(i, j), round(s, 9)))
    return sorted(out)


def some_strings(seed, n):
    rng = random.Random(seed)
    texts = ["", "", None, "é", "e", "日本", "a" * 30, "a" * 29, "ab" * 20, "x", "xy"]
    while len(texts) < n:
        if rng.random() < 0.5 and len(texts) > 11:
            t = list(rng.choice(texts) or "q")
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
            texts.append("".join(t))
        else:
            texts.append("".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))))
    return [(k, t, rng.choice("pq")) for k, t in enumerate(texts)]


@pytest.mark.parametrize("least, placed", [(0.6, 128), (0.7, 10), (0.85, 128), (0.85, 20), (1.0, 128)])
def test_near_strings_by_hand(spark, monkeypatch, least, placed):
    monkeypatch.setattr(similarity, "PLACED", placed)
    rows = some_strings(int(least * 100) + placed, 160)
    df = spark.createDataFrame(rows, "id long, text string, block string")
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in similarity.near_strings(df, "id", "text", least, block="block").collect())
    assert got == by_hand(rows, least)


@pytest.mark.parametrize("least, placed, tile", [(0.6, 128, 7), (0.7, 10, 100), (0.85, 20, 7), (1.0, 128, 7)])
def test_near_strings_in_tiles_by_hand(spark, monkeypatch, least, placed, tile):
    monkeypatch.setattr(similarity, "PLACED", placed)
    monkeypatch.setattr(similarity, "MANY", 2)
    monkeypatch.setattr(similarity, "TILE", tile)
    monkeypatch.setattr(similarity, "LIST", 3)
    rows = some_strings(int(least * 100) + placed, 120)
    rows += [(500 + k, f"a name {k:05d}", "p") for k in range(90)] + [(600, "a name \x00", "p"), (601, "a name \x00\x00", "p")]
    df = spark.createDataFrame(rows, "id long, text string, block string")
    got = sorted((r.a, r.b, round(r.similarity, 9)) for r in similarity.near_strings(df, "id", "text", least, block="block").collect())
    assert got == by_hand(rows, least)


def test_rows_of_equal_strings_are_paired_by_lists(spark):
    df = spark.createDataFrame([(k, ("old plate", "cold plate", "xyz")[k % 3]) for k in range(4500)], "id long, text string")
    found = similarity.near_strings(df, "id", "text", 0.7, digits=3)
    n = 1500
    assert {r.similarity: r.n for r in found.groupBy("similarity").agg(F.count_if(F.col("a") < F.col("b")).alias("n")).collect()} == {1.0: 3 * n * (n - 1) // 2, 0.9: n * n}


def test_strings_with_a_common_beginning_make_few_rows(spark):
    rows = [(0, f"supplier#{7 * k % 100_000:09d}", 18) for k in range(8000)]
    df = spark.createDataFrame(rows, "block int, x string, m int")
    began = time.time()
    found = similarity.similar_strings(df, 0.94)  # one edit: 0.055 of 18
    assert {(r.x[-5:], r.y[-5:]) for r in found.collect()} == {(x, y) for x, y in _one_digit_apart({r[1][-5:] for r in rows})}
    assert time.time() - began < 60


def _one_digit_apart(numbers):
    return {(x, y) for x in numbers for k in range(5) for d in "0123456789" for y in [x[:k] + d + x[k + 1 :]] if x < y and y in numbers}


def test_near_strings_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert similarity.near_strings(empty, "id", "text", 0.8).collect() == []
    with pytest.raises(ValueError, match="least"):
        similarity.near_strings(empty, "id", "text", 0.0)


def test_candidates_grow_with_the_strings(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(12, 24))) for _ in range(8000)]

    def candidates(n):
        df = spark.createDataFrame([(0, x, len(x)) for x in names[:n]] + [(0, x[:6] + "#" + x[7:], len(x)) for x in names[:n]], "block int, x string, m int")
        return similarity.string_candidates(df, 0.85).select("x", "y").distinct().count()

    few, many = candidates(2000), candidates(8000)
    assert few >= 2000 and many < 4.5 * few


def test_distances_of_long_strings_by_hand(spark, monkeypatch):
    monkeypatch.setattr(scores, "LONG", 3)
    rng = random.Random(8)
    rows = [(a, b) for _, a, _ in some_strings(5, 40) for _, b, _ in some_strings(6, 12)]
    rows += [(x + a + y, x + b + y) for a, b in rows[:200] if a is not None and b is not None for x, y in [("é" * rng.randrange(9), "aa日" * rng.randrange(5))]] + [("aaa", "aaaaa"), ("aba", "ababa")]
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", scores.byte_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in found] == [None if a is None or b is None else distance(a.encode(), b.encode()) for a, b in rows]


def test_distances_of_long_strings_that_are_nearly_alike_take_no_long(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdeé ") for _ in range(100_000)) for _ in range(12)]
    df = spark.createDataFrame([(t, "fr" + t if k % 2 else t[:50_000] + "#" + t[50_003:]) for k, t in enumerate(texts)], "a string, b string").repartition(4)
    began = time.time()
    found = [r.d for r in df.select(scores.byte_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert found.count(2) == 6 and all(2 <= d <= 6 for d in found)
    assert time.time() - began < 15


def some_vectors(seed, n, d=12, clusters=40, apart=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    return [[float(x) for x in centres[k % clusters] + apart * rng.normal(size=d)] for k in range(n)]


def cosines(rows, others, least, alone):
    out = []
    for i, v in rows:
        for j, w in others:
            if v and w and len(v) == len(w) and None not in v and None not in w and any(v) and any(w) and (i < j or not alone):
                s = float(np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)))
                if s >= least:
                    out.append((i, j, round(s, 9)))
    return sorted(out)


@pytest.mark.parametrize("least, most, spare", [(0.9, 64, 32), (0.3, 50, 1000), (0.99, 16_384, 1024), (-1.0, 100, 100)])
def test_near_vectors_by_hand(spark, monkeypatch, least, most, spare):
    monkeypatch.setattr(vectors, "MOST", most)
    monkeypatch.setattr(vectors, "LEAST", spare)
    rows = list(enumerate(some_vectors(1, 300) + some_vectors(2, 40, d=3)))
    rows += [(900, [1.0] * 12)] * 3 + [(901 + k, [1.0] * 12) for k in range(90)] + [(995, None), (996, []), (997, [0.0] * 12), (998, [1.0, None, 2.0]), (999, [-1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    shown = lambda found: sorted((r.a, r.b, round(r.similarity, 9)) for r in found.collect())
    assert shown(vectors.near_vectors(df, least)) == cosines(rows, rows, least, True)
    some = rows[::7] + [(900, [1.0] * 12), (None, [1.0] * 12)]
    asked = spark.createDataFrame(some, df.schema)
    assert shown(vectors.near_vectors(df, least, queries=asked)) == cosines([r for r in some if r[0] is not None], rows, least, False)


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id string, embedding array<float>")
    assert vectors.near_vectors(empty, 0.5).collect() == []
    one = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [2.0, 4.1])], empty.schema)
    assert [(r.a, r.b) for r in vectors.near_vectors(one, 0.5).collect()] == [("x", "y")]
    assert vectors.near_vectors(empty, 0.5, queries=one).collect() == []


def test_vectors_with_clusters_visit_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST", 64)
    monkeypatch.setattr(vectors, "LEAST", 64)

    def visitors(n):
        df = spark.createDataFrame(list(enumerate(some_vectors(3, n, clusters=n // 50))), "vec_id long, embedding array<double>")
        found = vectors.visits(df, 0.95).cache()
        return found.where("kind = 1").count(), found.select("block").distinct().count()

    few, many = visitors(1000), visitors(4000)
    assert few[0] < 0.2 * 1000 * few[1] / 2 and many[0] < 0.1 * 4000 * many[1] / 2
    assert many[0] < 6 * few[0]  # all pairs of blocks would be 16 times as many
