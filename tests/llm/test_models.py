import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidepool.llm import ann, components, jaccard_join, lm_score, quality


def brute_components(texts, k, num, den):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_components_are_those_of_all_links(documents, k, num, den):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "   ", "one", "One", "one two", "ONE\tTWO", "a b c", "A  b\nc", "É é"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 160))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy[: len(copy) - rng.randint(0, 3)]) + (" " + passage if rng.random() < 0.3 else ""))
    texts += [passage] * 5
    got = jaccard_join.join_components(documents(texts), k=k, num=num, den=den).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute_components(texts, k, num, den)


def test_join_of_empty_and_repeated_rows(documents, spark):
    assert jaccard_join.join_components(documents([])).count() == 0
    same = " ".join(map(str, range(30)))
    rows = jaccard_join.join_components(documents([same, same, "x y z"], [4, 4, 9])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(4, 4), (4, 4), (9, 9)]
    nulls = spark.createDataFrame([(None, same), (2, same)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.join_components(nulls).collect()) == [(0, 0), (2, 2)]


def test_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, **{k: 100 for k in range(100, 160)}}


def test_nearest_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((5, 64))
    vectors = np.vstack([rng.standard_normal((2500, 64)), (centres[rng.integers(0, 5, 500)] + 0.05 * rng.standard_normal((500, 64)))]).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None), (5020, [0.0] * 64), (5040, [float("nan")] * 64), (5060, [1.0] * 3), (5061, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found: dict = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, []).append(r)
    exact = vectors.astype(float)
    hit = total = 0
    for q in range(0, 3000, 20):
        s = exact @ exact[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(3000), -s))[:20].tolist())
        got = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 21)) and all(math.isclose(r.score, s[r.vec_id], abs_tol=1e-9) for r in got)
        hit, total = hit + len(best & {r.vec_id for r in got}), total + 20
    assert hit / total >= 0.9
    assert [(r.vec_id, r.score) for r in found[5060]] == [(5061, 2.0)] and not {5000, 5020, 5040} & set(found)


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)], "vec_id long, embedding array<double>")
    rows = ann.search(df, df.where("vec_id % 20 = 0")).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in rows] == list(range(20))
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_classifier_tells_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").select("doc_id", "score", "quality", quality.held_out().alias("held"))
    rows = scored.collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held]
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in held) / len(held) > 0.95


def test_classifier_without_much_to_learn(documents, spark):
    docs = documents(["a b c", None, "", "x" * 200_000])
    for labels in ([], [(0, 1)], [(0, None), (None, 1)]):
        trees = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        scores = [r.s for r in quality.score(docs, trees, to="s").collect()]
        assert len(set(scores)) == 1 and 0 <= scores[0] <= 1
    trees = quality.fit(documents([]), spark.createDataFrame([(1, 0)], "doc_id long, quality int"))
    assert quality.score(documents([]), trees, to="s").count() == 0


def test_flat_trees_follow_the_splits():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    trees = quality.learn(x[:1500], y[:1500], rounds=40)
    assert ((trees.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    row, total, depth = x[1700], trees.prior, int(math.log2(trees.feature.shape[1] + 1))
    for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
        node = 0
        for _ in range(depth):
            node = 2 * node + (2 if row[f[node]] > t[node] else 1)
        total += v[node - len(f)]
    assert math.isclose(trees.score(row[None])[0], 1 / (1 + math.exp(-total)))


def test_scores_are_those_of_two_bigram_models(documents, spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 80))) + rng.choice(["", "!", " the the the"]) for _ in range(200)] + [None, "", "same", "same"]
    target = [" ".join(rng.choices(words[:20], k=30)) for _ in range(20)]
    got = lm_score.score(documents(texts), documents(target), vocabulary=40).orderBy("doc_id").collect()
    counts = Counter(w for t in texts for w in lm_score.words(t or ""))
    ids = {w: k + 2 for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:40])}

    def bigrams(t):
        x = [ids.get(w, 0) for w in lm_score.words(t or "")]
        return list(zip([1, *x[:-1]], x, strict=True)) if x else []

    def model(ts):
        pairs = Counter(b for t in ts for b in bigrams(t))
        one, context = Counter(), Counter()
        for (h, w), n in pairs.items():
            one[w] += n
            context[h] += n
        total = sum(one.values())

        def loss(h, w):
            single = one[w] / total
            seen = pairs[h, w] / context[h] if context[h] else single
            return -math.log((1 - lm_score.UNIGRAM - lm_score.UNIFORM) * seen + lm_score.UNIGRAM * single + lm_score.UNIFORM / 42)

        return loss

    wanted, background = model(target), model(texts)
    for r, t in zip(got, texts, strict=True):
        pairs = bigrams(t)
        assert r.n_tokens == len(pairs)
        assert math.isclose(r.score, sum(wanted(*b) - background(*b) for b in pairs) / len(pairs) if pairs else 0.0, abs_tol=2e-6)
    assert lm_score.score(documents([]), documents([])).count() == 0
    assert lm_score.score(documents(["a b"]), documents([])).first().n_tokens == 2
