"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles, as hashes of 64 bits. Two
documents link when their sets' Jaccard similarity reaches a threshold. The way:

1. All documents' shingles are counted into a sketch of fixed size. It gives a
   global order of shingles: those that stand out of the sketch's noise last, by
   their count, the others by hash. Any order is right; this one keeps common
   passages out of prefixes.
2. Documents with equal sets become one class, whose least doc_id stands for it.
3. Of its ordered set a class gives a prefix. With overlap o at least needed, the
   first n - o + l tokens of two similar sets share l at least. Each class takes
   the l from 1 to 8 that costs least, by the sketch's estimate of the candidates
   that its prefix meets; a pair is verified only when it shares as many tokens
   as the smaller l of both, within the prefixes that this l and the sizes of both
   ask for. Positions of shared tokens, and how many tokens before them no other
   prefix has, bound the overlap further.
4. Prefix tokens are joined in two steps, so that a large group of similar
   documents costs no pairs of all with all. First each token's documents meet
   only the most central one among them; verified links give components. Then
   documents outside of the central one's component meet the rest of their token's
   documents, pairs inside a component excepted. No pair of two components that
   shares enough tokens is left out, so components are those of all links.
5. Verification compares whole sets, in integers.

Words are hashed by sums of their bytes times random numbers, one for each place
(a keyed universal family: two words of up to 4,096 bytes collide for at most one in
2**56 keys, whatever the words; longer words are hashed by BLAKE2b), shingles by mixing
their words' hashes. Where hashes of 64 bits collide sets differ from the true ones;
nothing else is approximate.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.bpe import batches
from tidepool.llm.common import cut_lineage, discard, few_jobs, keyed_hashes, mix, small_batches, written
from tidepool.llm.components import components

#: The sketch has 2**22 counts: 16 MB while counting, 4 MB when broadcast, for any input.
SKETCH_BITS = 22
SLICE_BITS = 12
LEVELS = 8
#: Other documents that a rare shingle meets, in the estimate of costs.
RARE = 0.05
#: Bits of the filter that keeps documents out of a shuffle that no candidate pair has: 32 MB at most.
FILTER_BITS = 28
#: What verifying a candidate costs, in tokens read from a prefix.
VERIFY_COST = 50
U = np.uint64


@lru_cache(1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """(value of each byte, with A-Z as a-z; whether it is white space)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return lower.astype(U) + U(1), space


def shingle_hashes(texts: list[str], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order of texts, and the text of each; a text of fewer words has its whole sequence as one."""
    values, space = _byte_tables()
    parts = [x.encode("utf-8", "surrogatepass") for x in texts]
    joined = b" ".join([*parts, b""])
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    inside = ~space[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, U), np.zeros(0, np.int64)
    words = keyed_hashes(values[data], start, end - start, lambda j: joined[start[j] : end[j]].lower())
    text = np.searchsorted(np.cumsum([len(x) + 1 for x in parts]), start, side="right")
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n

    def of(at: np.ndarray, m: int) -> np.ndarray:
        h = np.full(len(at), m, U)
        for j in range(m):
            h = mix(h * U(0x9FB21C651E98DF25) + words[at + j])
        return h

    whole = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :]) if len(text) >= k else np.zeros(0, np.int64)
    found, owner = [of(whole, k)], [text[whole]]
    for m in range(1, k):
        few = np.flatnonzero(n == m)
        found.append(of(first[few], m))
        owner.append(few)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], owner[order]


def shingle_sets(texts: list[str], k: int = 3) -> list[np.ndarray]:
    """The sorted set of each text's shingles."""
    h, owner = shingle_hashes(texts, k)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _sketch(rows: DataFrame, k: int) -> np.ndarray:
    """How many documents have a shingle of each hash bucket, over all documents. The driver gets 4 bytes a bucket, whatever the input."""

    def count(parts):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for part in parts:
            for texts in batches(part.column(1), 500_000):
                h = np.concatenate([*shingle_sets(texts, k), np.zeros(0, U)])
                buckets, n = np.unique((h >> U(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                counts[buckets] += n.astype(np.uint32)
        if counts.any():
            slices = counts.reshape(-1, 1 << SLICE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([x.tobytes() for x in slices], pa.binary())], ["slice", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << SLICE_BITS, np.uint64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, np.uint32)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    counts = np.zeros((1 << (SKETCH_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint32)
    for r in few_jobs(rows.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary")):
        counts[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    return counts.reshape(-1)


def _weights(counts: np.ndarray) -> np.ndarray:
    """0 for buckets within the noise of many rare shingles, else 1 to 63: twice the logarithm of what stands out."""
    mean = counts.mean()
    out = np.maximum(0.0, counts - (mean + 4 * np.sqrt(mean) + 1))
    return np.minimum(63, np.ceil(2 * np.log2(1 + out))).astype(np.uint8)


def least_overlap(n, m, num: int, den: int):
    """The least whole overlap of sets of n and m with similarity num / den."""
    return -(-num * (n + m) // (num + den))


def prefix_levels(weights: np.ndarray, n: int, num: int, den: int) -> tuple[int, int]:
    """(l, tokens given) of a set whose ordered tokens have these weights; as many as the smallest partner asks for."""
    long = n - least_overlap(n, -(-num * n // den), num, den)
    most = max(1, min(LEVELS, n - long))
    met = np.cumsum(np.where(weights[: long + most] > 0, 2.0 ** (weights[: long + most] / 2.0), RARE))
    costs = [long + l + met[min(n, long + l) - 1] * (1 + VERIFY_COST / l) for l in range(1, most + 1)]
    l = int(np.argmin(costs)) + 1
    return l, min(n, long + l)


def _describe(rows: DataFrame, k: int, num: int, den: int, weights) -> DataFrame:
    """(doc_id, n, fp, ell, strange, tokens) of every row."""

    def run(parts):
        for part in parts:
            ids, seen = part.column(0), 0
            for texts in batches(part.column(1), 500_000):
                sets = shingle_sets(texts, k)
                out = []
                for s in sets:
                    n = len(s)
                    if not n:
                        out.append((0, None, 0, 0, np.zeros(0, np.int64)))
                        continue
                    w = weights.value[s >> U(64 - SKETCH_BITS)]
                    tokens = (w.astype(U) << U(58)) | (s >> U(6))
                    tokens.sort()
                    l, long = prefix_levels((tokens[: n] >> U(58)).astype(np.uint8), n, num, den)
                    out.append((n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), l, int(1000 * (w == 0).sum() // n), tokens[:long].astype(np.int64)))
                n, fp, ell, strange, tokens = zip(*out, strict=True)
                offsets = np.cumsum([0, *map(len, tokens)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(seen, len(texts)),
                        *(pa.array(x, t) for x, t in ((n, pa.int32()), (fp, pa.binary()), (ell, pa.int32()), (strange, pa.int32()))),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(tokens), pa.int64())),
                    ],
                    ["doc_id", "n", "fp", "ell", "strange", "tokens"],
                )
                seen += len(texts)

    return rows.mapInArrow(run, "doc_id long, n int, fp binary, ell int, strange int, tokens array<long>")


def _candidates(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of shared tokens with the two documents l and r, the pairs (a, b) with enough of them."""
    l, r = F.col("l"), F.col("r")
    need = F.ceil(F.lit(num) * (l["n"] + r["n"]) / F.lit(num + den))
    ell = F.least(l["ell"], r["ell"])
    # what comes before the token in both and could be common, and what is left from it on
    bound = F.least(l["live"], r["live"]) + F.least(l["n"] - l["pos"], r["n"] - r["pos"])
    meets = (F.least(l["n"], r["n"]) * den >= F.greatest(l["n"], r["n"]) * num) & (bound >= need)
    # both have it in the prefix within which a pair of these sizes shares ell tokens at least
    meets &= (l["pos"] < l["n"] - need + ell) & (r["pos"] < r["n"] - need + ell)
    kept = pairs.where(meets).select(F.least(l["doc"], r["doc"]).alias("a"), F.greatest(l["doc"], r["doc"]).alias("b"), ell.alias("ell"))
    return kept.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("ell").alias("ell")).where("shared >= ell").select("a", "b")


def _passing(ids: DataFrame, id: str, bits: int):
    """A bitmap of 2**bits that has every id (and by chance others): a test that keeps most documents out of a shuffle. It never drops an id."""
    width = 1 << max(0, bits - 12)

    def mark(parts):
        seen = np.zeros(1 << (bits - 3), np.uint8)
        for part in parts:
            at = _places(part.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(seen, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        slices = seen.reshape(-1, width // 8)
        some = np.flatnonzero(slices.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([slices[k].tobytes() for k in some], pa.binary())], ["slice", "bits"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]]).tobytes()]})

    bitmap = np.zeros((1 << 12 if bits > 12 else 1, width // 8), np.uint8)
    for r in few_jobs(ids.select(id).mapInArrow(mark, "slice int, bits binary").groupBy("slice").applyInPandas(join, "slice int, bits binary")):
        bitmap[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(bitmap.reshape(-1))


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) >> U(64 - bits)).astype(np.int64)


def _sets(rows: DataFrame, ids: DataFrame, id: str, k: int, bits: int) -> DataFrame:
    """(id, set_id) of documents whose id is in the column ``id`` of ``ids``, and maybe of others."""
    bitmap = _passing(ids, id, bits)

    def run(parts):
        for part in parts:
            part = part.filter(pa.compute.is_valid(part.column(0)))
            at = _places(part.column(0).to_numpy(zero_copy_only=False), bits)
            part, seen = part.filter(pa.array((bitmap.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))), 0
            for texts in batches(part.column(1), 500_000):
                sets = shingle_sets(texts, k)
                offsets = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(seen, len(texts)), lists], [id, f"set_{id}"])
                seen += len(texts)

    return rows.mapInArrow(run, f"{id} long, set_{id} array<long>")


def _verified(pairs: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs whose whole sets are similar."""
    # bounded, so at some size of the input the filters let everything pass
    bits = min(FILTER_BITS, max(16, int(np.ceil(np.log2(16 * pairs.count() + 1)))))
    both = pairs.join(_sets(rows, pairs, "b", k, bits), "b").join(_sets(rows, pairs, "a", k, bits), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    both = both.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("n"), common.alias("common"))
    return both.where(F.lit(den) * F.col("common") >= F.lit(num) * (F.col("n") - F.col("common"))).select("a", "b")


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link when similarity of their k-word shingles is num / den or more.

    A component's id is the least doc_id reachable by links. Null and empty texts have empty sets and link with nothing; a null
    doc_id has no component. Rows stay rows; texts that share a doc_id count as one document with the links of each.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    weights = docs.sparkSession.sparkContext.broadcast(_weights(_sketch(rows, k)))
    all_docs = written(_describe(rows, k, num, den, weights))

    own = all_docs.where("n > 0 AND doc_id IS NOT NULL")
    meta = own.groupBy("fp").agg(F.min_by(F.struct("doc_id", "n", "ell", "strange"), "doc_id").alias("c")).select(F.col("c.doc_id").alias("doc"), "c.n", "c.ell", "c.strange")
    posted = own.groupBy("fp").agg(F.min_by(F.struct("doc_id", "tokens"), "doc_id").alias("c")).select(F.col("c.doc_id").alias("doc"), F.posexplode("c.tokens").alias("pos", "token"))
    repeated = posted.groupBy("token").count().where("count > 1").select("token")
    shared = posted.join(repeated, "token").join(meta, "doc")
    # tokens before a shared one that no other prefix has are in no document that has the shared one in its prefix
    live = F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1
    shared = written(shared.select("token", F.struct("strange", "doc", "n", "ell", "pos", live.alias("live")).alias("d")))

    # the most central document of a token's is that with the fewest rare shingles
    centres = shared.groupBy("token").agg(F.min("d").alias("centre"))
    stars = shared.join(centres, "token").where("d.doc <> centre.doc").select(F.col("d").alias("l"), F.col("centre").alias("r"))
    tried = cut_lineage(_candidates(stars, num, den))
    links = cut_lineage(_verified(tried, rows, k, num, den))
    groups = components(links)

    # what is left: documents of different components that share a token
    placed = shared.join(groups.select(F.col("node"), "component"), F.col("d.doc") == F.col("node"), "left").select("token", "d", F.coalesce("component", "d.doc").alias("of"))
    of_centre = placed.groupBy("token").agg(F.min(F.struct("d", "of")).alias("c"), F.min("of").alias("low"), F.max("of").alias("high"))
    of_centre = of_centre.where("low <> high").select("token", F.col("c.of").alias("of_centre"))
    placed = written(placed.join(of_centre, "token"))
    outside = placed.where("of <> of_centre").select("token", F.col("d").alias("l"), F.col("of").alias("of_l"))
    others = placed.select("token", F.col("d").alias("r"), F.col("of").alias("of_r"), (F.col("of") == F.col("of_centre")).alias("inside"))
    rest = outside.join(others, "token").where("of_l <> of_r AND (inside OR l.doc < r.doc)")
    more = cut_lineage(_candidates(rest, num, den).join(tried, ["a", "b"], "left_anti"))
    # the components so far are links already, which need no more steps among themselves
    links = cut_lineage(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").unionByName(_verified(more, rows, k, num, den)))
    discard(shared)
    discard(placed)

    groups = components(links)
    reps = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = reps.join(groups, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return all_docs.join(reps, "fp", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
