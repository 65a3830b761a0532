"""Search by one vector through the index against a scan, and how much it reads."""

import numpy as np
import pytest

from tidepool.operators.vector_index import Index


def some_vectors(seed, n, d=10, clusters=30, apart=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    return [[float(x) for x in centres[k % clusters] + apart * rng.normal(size=d)] for k in range(n)]


def by_hand(rows, query, k, least=-1.0, but=None):
    out = []
    for i, v in rows:
        if v and len(v) == len(query) and None not in v and any(v) and i != but and i is not None:
            s = float(np.dot(v, query) / np.sqrt(np.dot(v, v) * np.dot(query, query)))
            if s >= least:
                out.append((i, s))
    return sorted(out, key=lambda r: (-round(r[1], 12), r[0]))[:k]


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(some_vectors(1, 1500)))
    out += [(5000 + k, [1.0] * 10) for k in range(60)] + [(6000, None), (6001, []), (6002, [0.0] * 10), (6003, [1.0, 2.0]), (6004, [2.0, 1.0]), (None, [1.0] * 10), (6005, [1.0] * 9 + [None])]
    return out


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    found = Index(spark, str(tmp_path_factory.mktemp("vectors")))
    found.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=50)
    return found


@pytest.mark.parametrize("which", [0, 7, 5001, "far", "short", "none"])
def test_nearest_as_a_scan_finds_them(index, rows, which):
    query = {"far": [float(-k) for k in range(10)], "short": [1.0, 1.9], "none": [0.0] * 10}.get(which) or rows[which if which < 1500 else 1500][1]
    but = which if isinstance(which, int) else None
    got, share = index.nearest(query, 20, but=but)
    want = by_hand(rows, query, 20, but=but) if any(query) else []
    assert [r[0] for r in got] == [r[0] for r in want] and np.allclose([r[1] for r in got], [r[1] for r in want])
    assert share < 0.5 if isinstance(which, int) else share <= 1
    near, _ = index.nearest(query, 3, least=0.99, but=but)
    assert [r[0] for r in near] == [r[0] for r in want if r[1] >= 0.99][:3]


def test_nothing_is_near_nothing(spark, tmp_path):
    none = Index(spark, str(tmp_path))
    none.build(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.nearest([1.0, 2.0], 3)[0] == [] and none.nearest([], 3) == ([], 0.0) and none.nearest([float("nan")], 1) == ([], 0.0)
