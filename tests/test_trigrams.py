"""Substring search through the index against a scan, and what it reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidepool.operators.trigrams import Index, pieces


def like_to_regex(pattern: str) -> str:
    """A LIKE pattern as a regular expression."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            out, k = out + re.escape(pattern[k + 1]), k + 2
            continue
        out += {"%": "(?s:.*)", "_": "(?s:.)"}.get(c, re.escape(c))
        k += 1
    return rf"\A{out}\Z"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "50%", "a_b", "x", "Été", "STRASSE", "straße", "日本語", "back\\slash", "naïve", "zebra"]
    out = [(k, " ".join(rng.choice(words[:-1]) for _ in range(rng.randint(0, 6))), k % 7) for k in range(600)]
    return out + [(600, None, 1), (601, "", 1), (602, "one zebra\nand a Zebra\nno", 1), (603, "ab", 2), (-5, "zebras", 3), (604, "🙂🙃🙂 x🙂y", 2), (10_000, "ALPHABETA\nzebra", 3)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    found = Index(spark, str(tmp_path_factory.mktemp("index")), "id", "text")
    found.build(spark.createDataFrame(rows, "id long, text string, n int"), buckets=32, width=50)
    return found


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize("word", ["zebra", "alpha", "ALPHABETA", "a_b", "50%", "x", "", "日本", "日本語", "Été", "beta gamma", "nothing at all", "a b", "h\\s", "a beta gamma a_b", "🙃🙂 x", "x🙂y"])
def test_words_as_a_scan_finds_them(index, rows, word):
    assert ids(index.contains(word)) == sorted(i for i, t, _ in rows if t is not None and word.lower() in t.lower())
    assert ids(index.contains(word, ignore_case=False)) == sorted(i for i, t, _ in rows if t is not None and word in t)


@pytest.mark.parametrize("pattern", ["%zebra%", "zebra%", "%alpha%gamma%", "a_pha", "%50\\%%", "%a\\_b%", "_", "%", "", "ab", "%pha_b%", "%日本語"])
def test_wildcards_as_a_scan_finds_them(index, rows, pattern):
    assert ids(index.like(pattern, ignore_case=False)) == sorted(i for i, t, _ in rows if t is not None and re.search(like_to_regex(pattern), t))
    assert ids(index.like(pattern)) == sorted(i for i, t, _ in rows if t is not None and re.search(like_to_regex(pattern), t, re.I))


def test_pieces_of_patterns():
    assert pieces("%one\\%two_three%") == ["one%two", "three"] and pieces("%%_") == [] and pieces("a\\\\b") == ["a\\b"]


def test_lines_and_expressions(index):
    assert sorted(map(tuple, index.lines("zebra").collect())) == [(-5, 0, "zebras"), (602, 0, "one zebra"), (10_000, 1, "zebra")]
    assert sorted(map(tuple, index.lines("zebra", ignore_case=True).collect())) == [(-5, 0, "zebras"), (602, 0, "one zebra"), (602, 1, "and a Zebra"), (10_000, 1, "zebra")]
    assert ids(index.matches(r"zebra[s\n]", ["zebra"])) == [-5, 602]


def test_a_search_reads_few_files(spark, index):
    def read(df):
        return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}

    every, some = read(index.spark.read.parquet(f"{index.path}/texts")), read(index.parts_of(index.candidates(["zebra"])))
    assert len(some) <= 3 < len(every) / 3
    runs = read(index.spark.read.parquet(f"{index.path}/runs"))
    assert len(read(index.posting(["zeb"]))) < 0.2 * len(runs)


def test_an_index_of_nothing(spark, tmp_path):
    none = Index(spark, str(tmp_path), "id", "text")
    none.build(spark.createDataFrame([(1, None)], "id long, text string"), 4, 10)
    assert none.contains("abc").collect() == none.contains("a").collect() == []
