"""Large groups of near copies, and words that weak hashes take for equal."""

import random

import numpy as np
import pytest

from tests.llm.test_bpe_packing import thue_morse
from tests.llm.test_models import brute_components
from tidepool.llm import ann, jaccard_join


def test_words_that_polynomials_confuse_are_told_apart(documents):
    a, b = thue_morse(1024)
    c, d = thue_morse(8192)
    rest = [f"w{i}" for i in range(30)]
    texts = [" ".join([*rest[:15], w, *rest[15:]]) for w in (a, b, c, d, "x" * 5000, "x" * 4999 + "X", "x" * 4999 + "Y")]
    sets = jaccard_join.shingle_sets(texts, 3)
    assert len({s.tobytes() for s in sets}) == 6 and (sets[4] == sets[5]).all()
    got = jaccard_join.join_components(documents(texts)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [0, 1, 2, 3, 4, 4, 6]


def test_thousands_of_near_copies_with_a_side_group(documents):
    """Copies of one text with few edits, others with so many that they link with none or through others only, and a group that hangs on
    the first by a chain of outsiders: components are those of all links."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    side = [w if k % 9 else f"s{k}" for k, w in enumerate(base)]
    chain = [[*side[: 10 * k], *base[10 * k :]] for k in range(13)]
    texts = [" ".join(x) for x in chain]
    for _ in range(1500):
        own = list(base if rng.random() < 0.8 else side)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5, 8])):
            own[rng.randrange(120)] = rng.choice(words[:40])
        texts.append(" ".join(own))
    rng.shuffle(texts)
    got = jaccard_join.join_components(documents(texts), k=5, num=4, den=5).orderBy("doc_id").collect()
    want = brute_components(texts, 5, 4, 5)
    assert [tuple(r) for r in got] == want and 1 < len({r[2] for r in want}) < len(texts) / 2


@pytest.mark.parametrize("noise,most", [(0.05, 0.2), (1.0, 0.9)])
def test_queries_read_a_share_of_the_cells(spark, noise, most):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 12_000)] + noise * rng.standard_normal((12_000, 32))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    cells = ann.Cells(x, len(x), 20, ann.RECALL)
    assert len(cells.centres) >= 8 and cells.probes <= max(2, most * len(cells.centres))
    found: dict = {}
    for r in ann.search(df, df.where("vec_id % 200 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 200):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & found[q])
    assert hit >= 0.9 * 20 * 60 and len(found) == 60


def test_repeated_rows_have_results_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 0.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 0"), k=3).collect())
    one = [(0, 1, 1, 3.0), (0, 2, 0, 1.0), (0, 3, 2, 1.0)]
    assert got == sorted([*one, *one, (0, 1, 2, 2.0), (0, 2, 0, 0.0), (0, 3, 0, 0.0)])


def test_a_long_text_among_others(documents):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = jaccard_join.join_components(documents([long, long + " end", "short one", long[: len(long) // 2]])).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in rows][:3] == [(59_998, 0), (59_999, 0), (1, 2)] and rows[3].component_id == 3


def test_partitions_of_a_shuffle_are_no_jobs(documents, spark):
    """What the driver gathers took a job for each partition: 1,167 on check_h, whose records filled the driver's memory."""
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    conf = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        texts = [" ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(41)), "another text", None]
        began = jobs()
        assert [r.component_id for r in jaccard_join.join_components(documents(texts)).orderBy("doc_id").collect()] == [0, 0, 2, 3]
        assert jobs() - began < 300
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
