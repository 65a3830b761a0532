"""How much two texts share in matching blocks, for many pairs at once.

The longest run that both texts have (of equal ones that which begins first in the first text, then in the second) is a block; what lies before it in both, and what lies
behind it, is searched in the same way. Runs of equal characters are found once, for all pairs; the searches of a round, of all pairs, then go together:
each takes its longest run, and the other runs are cut at the block. In second texts of 200 characters and more, a character that makes up more than
a hundredth of them begins no block, but may lengthen one.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: From which size on frequent characters begin no block, and which are: more than this share of the text, and one.
LONG, SHARE = 200, 100
#: Equal characters of the pairs that go together, at most as far as their sizes tell; a pair that may have more goes alone.
TOGETHER = 1 << 21


def _codes(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in texts], np.int64)
    out = np.full((len(texts), int(size.max(initial=0)) + 1), pad, np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out, size


def _begins(b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which characters of the second texts may begin a block."""
    ok = np.ones(b.shape, bool)
    for k in np.flatnonzero(size >= LONG).tolist():
        own = b[k, : size[k]]
        _, which, n = np.unique(own, return_inverse=True, return_counts=True)
        ok[k, : size[k]] = n[which] <= size[k] // SHARE + 1
    return ok


def _runs(a: np.ndarray, b: np.ndarray, ok: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Rows (pair, place in the first text, in the second, size): all longest runs of equal characters of which each may begin a block."""
    of, j = np.nonzero(ok & (np.arange(b.shape[1]) < b_size[:, None]))
    keys = (of.astype(np.int64) << 32) | b[of, j]
    order = np.argsort(keys, kind="stable")
    keys, j = keys[order], j[order]
    pair, i = np.nonzero(np.arange(a.shape[1]) < a_size[:, None])
    asked = (pair.astype(np.int64) << 32) | a[pair, i]
    low = np.searchsorted(keys, asked)
    n = np.searchsorted(keys, asked, side="right") - low
    place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    pair, i, j = np.repeat(pair, n), np.repeat(i, n), j[place]
    # the last column of both is padding, which equals nothing, and so is what lies before the first
    first = (i == 0) | (j == 0) | (a[pair, i - 1] != b[pair, j - 1]) | ~ok[pair, j - 1]
    pair, i, j = pair[first], i[first], j[first]
    size, on = np.ones(len(pair), np.int64), np.arange(len(pair))
    while len(on):
        p, x, y = pair[on], i[on] + size[on], j[on] + size[on]
        on = on[(a[p, x] == b[p, y]) & ok[p, y]]
        size[on] += 1
    return np.stack([pair, i, j, size], 1)


def _together(first: list[str], second: list[str]) -> np.ndarray:
    """The characters in matching blocks of each pair."""
    n = len(first)
    (a, a_size), (b, b_size) = _codes(first, -1), _codes(second, -2)
    ok, matched = _begins(b, b_size), np.zeros(n, np.int64)
    runs = _runs(a, b, ok, a_size, b_size)
    work = np.stack([np.arange(n), np.zeros(n, np.int64), a_size, np.zeros(n, np.int64), b_size], 1)
    of = runs[:, 0]  # the search that a run belongs to, in order
    kept = (a_size > 0) & (b_size > 0)
    work, of = work[kept], (np.cumsum(kept) - 1)[of]
    while len(work):
        pair, a0, a1, b0, b1 = work.T
        i, j, k = a0.copy(), b0.copy(), np.zeros(len(work), np.int64)
        if len(runs):
            begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            most = np.maximum.reduceat(runs[:, 3], begin)
            longest = runs[:, 3] == np.repeat(most, np.diff(np.append(begin, len(of))))
            place = np.where(longest, (runs[:, 1] << 32) | runs[:, 2], np.iinfo(np.int64).max)
            place, own = np.minimum.reduceat(place, begin), of[begin]
            i[own], j[own], k[own] = place >> 32, place & ((1 << 32) - 1), most
        # characters that begin no block may stand at both its ends
        on = np.arange(len(work))
        while len(on):
            on = on[(i[on] > a0[on]) & (j[on] > b0[on])]
            on = on[a[pair[on], i[on] - 1] == b[pair[on], j[on] - 1]]
            i[on], j[on], k[on] = i[on] - 1, j[on] - 1, k[on] + 1
        on = np.arange(len(work))
        while len(on):
            on = on[(i[on] + k[on] < a1[on]) & (j[on] + k[on] < b1[on])]
            on = on[a[pair[on], i[on] + k[on]] == b[pair[on], j[on] + k[on]]]
            k[on] += 1
        np.add.at(matched, pair, k)
        before = (k > 0) & (a0 < i) & (b0 < j)
        behind = (k > 0) & (i + k < a1) & (j + k < b1)
        where = np.cumsum(np.stack([before, behind], 1).reshape(-1)).reshape(-1, 2) - 1
        # runs are cut at the block: what begins before it, and what ends behind it
        x, y, size = runs[:, 1], runs[:, 2], runs[:, 3]
        left = np.minimum(size, np.minimum(i[of] - x, j[of] - y))
        off = np.maximum(0, np.maximum(i[of] + k[of] - x, j[of] + k[of] - y))
        l, r = np.flatnonzero(before[of] & (left > 0)), np.flatnonzero(behind[of] & (size > off))
        runs = np.concatenate([np.stack([runs[l, 0], x[l], y[l], left[l]], 1), np.stack([runs[r, 0], x[r] + off[r], y[r] + off[r], size[r] - off[r]], 1)])
        of = np.concatenate([where[of[l], 0], where[of[r], 1]])
        order = np.argsort(of, kind="stable")
        runs, of = runs[order], of[order]
        parts = np.stack([np.stack([pair, a0, i, b0, j], 1), np.stack([pair, i + k, a1, j + k, b1], 1)], 1)
        work = parts[np.stack([before, behind], 1)]
    return matched


def ratios(first: list[str], second: list[str]) -> np.ndarray:
    """Twice the characters in matching blocks, of the characters of both texts; 1 for two empty texts."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(first, second, strict=True)], np.int64).reshape(-1, 2)
    equal = sizes[:, 0] * np.where(sizes[:, 1] < LONG, sizes[:, 1], sizes[:, 1] // SHARE + 1)
    matched, group = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    group = np.cumsum(equal) // TOGETHER
    for g in np.unique(group[equal <= TOGETHER]).tolist():
        some = np.flatnonzero((group == g) & (equal <= TOGETHER))
        matched[some] = _together([first[k] for k in some], [second[k] for k in some])
    for k in np.flatnonzero(equal > TOGETHER).tolist():
        matched[k] = sum(m.size for m in SequenceMatcher(None, first[k], second[k]).get_matching_blocks())
    total = sizes.sum(1)
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)
