"""Hard negatives, the filters' audit and token counts against brute force on small tables."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm import bpe, filter_audit, hard_negatives, token_counts

VECTORS = "vec_id long, label int, embedding array<double>, v string, score string, uid string, rank int, slice int"


def vectors(spark, rows):
    """Vectors with columns whose names clash with those of the operator."""
    return spark.createDataFrame([(i, label, e, "v", "s", "u", 1, 2) for i, label, e in rows], VECTORS)


def mined(df, **more):
    rows = df.withColumn("v", hard_negatives.quantised(F.col("embedding")))
    return sorted(map(tuple, hard_negatives.mine(rows, F.col("vec_id") % 10 == 0, **more).collect()))


def by_hand(rows, k=5):
    good = [(i, label, [math.floor(256 * x) for x in e]) for i, label, e in rows if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (i, label, v) in enumerate(good):
        if i % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, b, m) for b, (j, m, w) in enumerate(good) if b != a and len(w) == len(v)]
        for score, j, _, _ in sorted(x for x in scored if x[3] == label)[:k]:
            chosen = sorted(x for x in scored if x[3] != label and 80 * -score <= 100 * -x[0] <= 100 * -score)[:k]
            out += [(i, j, rank + 1, x[1], -score, -x[0]) for rank, x in enumerate(chosen)]
    return sorted(out)


def some_vectors(seed, n, d=6):
    rng = random.Random(seed)
    rows = [(k, rng.choice([0, 0, 0, 1, 2]), [rng.gauss(0.4, 1) * rng.choice([0.01, 1, 3]) for _ in range(d)]) for k in range(n)]
    rows += [(rng.randrange(40), *rows[rng.randrange(n)][1:]) for _ in range(20)]  # ids and vectors again
    rows += [rows[10], rows[10], rows[20]]
    return rows


@pytest.mark.parametrize("bucket, block, least", [(1024, 64, 8192), (7, 3, 20)])
def test_hard_negatives_by_hand(spark, monkeypatch, bucket, block, least):
    for name, x in (("BUCKET", bucket), ("BLOCK", block), ("LEAST", least)):
        monkeypatch.setattr(hard_negatives, name, x)
    rows = some_vectors(3, 300)
    rows += [(400, None, [1.0] * 6), (410, 1, None), (420, 1, [1.0, None] * 3), (430, 1, [math.nan] * 6), (440, 1, [math.inf] * 6), (None, 1, [2.0] * 6)]
    rows += [(450, 1, [0.0] * 6), (460, 7, [1.0] * 6), (470, 1, [1.0, 2.0]), (471, 1, [2.0, 2.0]), (472, 2, [1.9, 2.0]), (480, 3, []), (481, 3, []), (482, 4, [])]
    got = mined(vectors(spark, rows))
    assert got == by_hand(rows) and len({r[0] for r in got}) > 20


def test_hard_negatives_of_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST", 40)
    rows = [(k, k % 3, [0.5, 0.5, 0.5] if k % 2 else [0.1 * (k % 7), 0.3, 0.4]) for k in range(240)]
    assert mined(vectors(spark, rows)) == by_hand(rows)


def test_hard_negatives_of_large_numbers(spark):
    rng = random.Random(5)
    rows = [(k, k % 2, [float(rng.randrange(1 << 20)) + 0.5 for _ in range(3)]) for k in range(60)]
    assert mined(vectors(spark, rows)) == by_hand(rows)
    with pytest.raises(ValueError, match="64 bits"):
        mined(vectors(spark, [(0, 1, [1e18])]))


def test_hard_negatives_of_nothing(spark):
    assert mined(vectors(spark, [])) == mined(vectors(spark, [(0, 1, [1.0])])) == []
    with pytest.raises(ValueError, match="share"):
        mined(vectors(spark, []), share=(100, 100))


def test_bounds_of_norms_spare_products():
    rng = np.random.default_rng(1)
    v = np.rint(rng.normal(size=(20_000, 8)) * np.geomspace(1000, 1, 20_000)[:, None]).astype(np.int64)
    ids = np.arange(len(v))
    held = hard_negatives.Slice(ids, ids, np.array(["x"] * len(v), object), np.sqrt((v * v).sum(1).astype(float)), v)
    anchors = v[:64]
    own = np.full(64, -1)
    low, high = np.full(64, -(2**63)), np.full(64, 2**63 - 1)
    norms = np.sqrt((anchors * anchors).sum(1).astype(float))
    q, c, score = held.best(own, held.coded(["x"] * 64), norms, anchors, np.arange(64), low, high, True, 5)
    want = np.sort(anchors @ v.T, axis=1)[:, ::-1][:, :5]
    assert (score.reshape(64, 5) == want).all()
    assert held.read < 0.2 * 64 * len(v)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audited_by_hand(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    flags = []
    for i, text, part in docs:
        text = text or ""
        words = WORD.findall(text)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]}
        mark = lambda k: any(x[0] == i and i is not None and x[k] == 1 for x in labels)  # noqa: E731, B023
        flags.append((part or "", f, mark(1), mark(2)))
    shapley, out = Counter(), Counter()
    for part, f, good, toxic in flags:
        for order in itertools.permutations("ABCDE"):
            first = next((k for k, x in enumerate(order) if f[x]), 5)
            for k, x in enumerate(order):
                key = (part, "".join(order), k + 1)
                removed = first == k
                for place, hit in enumerate([first > k, removed, first < k and f[x], sum(f.values()) == 1 and f[x], removed and good, removed and toxic]):
                    out[key, place] += hit
                shapley[part, x] += removed
    return sorted((*key, *(out[key, place] for place in range(6)), shapley[key[0], key[1][key[2] - 1]]) for key in {key for key, _ in out})


def audit(docs, labels):
    return sorted(map(tuple, filter_audit.audit(filter_audit.flagged(docs, labels), marks={"good_lost": "good", "toxic_lost": "toxic"}).collect()))


def test_audit_by_hand(spark):
    rng = random.Random(2)
    words = ["a", "bee", "See", "D", "#e", "f|", "été", "　", "\x1c"]
    texts = [None, "", "", " \t\n", "same text", "same text", "X" * 50, "\v".join(f"w{k}" for k in range(200)), "w " * 200, "long " + " ".join(f"v{k}" for k in range(60_000))]
    texts += [rng.choice([" ", "\x0b", "\n"]).join(rng.choice([*words, f"n{rng.randrange(300)}"]) for _ in range(rng.choice([5, 150, 260, 400]))) for _ in range(60)]
    docs = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    docs += [(100 + k, *docs[rng.randrange(len(docs))][1:]) for k in range(25)] + [docs[4], docs[5], (5, "other", "en"), (None, "same text", "en"), (None, "only here", None), (-3, "same text", "fr")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    given = spark.createDataFrame([(i, t, p, 1, "x", True, 0) for i, t, p in docs], "doc_id long, text string, lang string, step int, part string, first boolean, E int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit(given, marks)
    assert got == audited_by_hand(docs, labels)
    assert len(got) == 600 * 4


def test_audit_of_empty_tables(spark):
    none, marks = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(none, marks) == []
    assert len(audit(spark.createDataFrame([(1, "a", "en")], none.schema), marks)) == 600
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(none, "ABCDEFGH")


def test_audit_of_other_filters(spark):
    flags = spark.createDataFrame([("p", True, None), ("p", True, True), (None, False, True)], "part string, x boolean, y boolean")
    got = filter_audit.audit(flags, "xy")
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley"]
    rows = {tuple(r[:3]): tuple(r[3:]) for r in got.collect()}
    assert rows["p", "xy", 1] == (0, 2, 0, 1, 3) and rows["p", "yx", 2] == (0, 1, 1, 1, 3) and rows["", "yx", 1] == (0, 1, 0, 1, 2)


ODD = ["", None, " ", "it's 's", "a<|endoftext|>b <|endoftext|>", "日本語 テキスト 🙂🙂 é ", "x" * 5000, "=-" * 400, "\t\tx\r\n\r\n  y", "one two " * 300, "Ünïcödé wörds"]


def test_counts_as_the_library(spark):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab 's\n\t.!1²é中🙂 'tlrevd-") for _ in range(rng.randint(1, 80))) for _ in range(400)] + ["the same text again"] * 50 + [" ".join(f"word{k % 900}" for k in range(40_000))]
    rows = [(k if k != 7 else None, t, "b", "t") for k, t in enumerate(texts)] + [(3, "repeated row", "b", "t")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, word string").repartition(3)
    key = lambda r: tuple(map(str, r))
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in rows), key=key)
    assert sorted(map(tuple, token_counts.count_tokens(docs).collect()), key=key) == want
    few = token_counts.frequent_words(docs, entries=3)
    assert len(few.keys) == 3
    assert sorted(map(tuple, token_counts.count_tokens(docs, frequent=few).collect()), key=key) == want


def test_counts_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(docs).collect() == []
    nulls = spark.createDataFrame([(1, None)], docs.schema)
    assert [tuple(r) for r in token_counts.count_tokens(nulls).collect()] == [(1, 0, 0, False)]


def test_frequent_words_of_one_hash_are_told_apart():
    words = [b"alike", b" the", b"equal"]
    hashes = np.array([5, 6, 5], np.uint64)
    table = token_counts.Frequent(words, [1, 2, 3], hashes)
    data = b"".join([*words, b"other"])
    at, size = np.array([0, 5, 9, 14]), np.array([5, 4, 5, 5])
    found = table.lookup(np.array([5, 6, 5, 5], np.uint64), np.frombuffer(data, np.uint8), at, size)
    assert found.tolist() == [1, 2, -1, -1]


def test_caches_start_anew_and_keep_no_long_words(monkeypatch):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    monkeypatch.setattr(token_counts, "CACHED", 4)
    none = token_counts.Frequent([], [], np.zeros(0, np.uint64))
    counter = token_counts.Counter(none, bpe.VOCABULARY)
    for text in ("one two three four five six", "z" * 3000, "seven one two", "one"):
        assert counter.count([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
        assert len(counter.cache) <= 10 and all(len(w) <= token_counts.LONG for w in counter.cache)
