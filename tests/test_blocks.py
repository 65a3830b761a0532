"""Matching blocks of many pairs at once against a search pair by pair."""

import random
import time
from difflib import SequenceMatcher

import numpy as np
import pytest

from tidepool.functions import blocks


def pairs(seed, n, letters, most):
    rng = random.Random(seed)
    out = [("", ""), ("", "a"), ("a", ""), ("a", "a"), ("abc", "cab"), ("🙂é🙂", "é🙂🙂")]
    while len(out) < n:
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
        b = list(a) if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.randint(0, most))]
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 8)] = [rng.choice(letters) for _ in range(rng.randint(0, 8))]
        out.append((a, "".join(b)))
    return out


@pytest.mark.parametrize("seed, n, letters, most", [(1, 600, "ab", 30), (2, 300, "abcdefgh ", 120), (3, 80, "etaoin shrdlucmfwypvbgkqjxz.,É", 500), (4, 40, "ab", 300), (5, 3, "abcdefghijklmnop", 3000)])
def test_ratios_are_those_of_each_pair(seed, n, letters, most):
    some = pairs(seed, n, letters, most)
    got = blocks.ratios([a for a, _ in some], [b for _, b in some])
    assert np.allclose(got, [SequenceMatcher(None, a, b).ratio() for a, b in some], atol=0, rtol=1e-15)


def test_no_pairs():
    assert blocks.ratios([], []).tolist() == []


def test_many_pairs_take_no_longer(capsys):
    some = pairs(6, 400, "etaoin shrdlucmfwypvbgkqjxz.,", 500)
    began = time.time()
    blocks.ratios([a for a, _ in some], [b for _, b in some])
    together = time.time() - began
    began = time.time()
    for a, b in some:
        SequenceMatcher(None, a, b).ratio()
    alone = time.time() - began
    with capsys.disabled():
        print(f"together {together:.2f} s, alone {alone:.2f} s")
