"""Hard negatives by a search over buckets of norms.

Candidates lie in slices: ranges of (label and dimensions by a hash, norm from large to small), a bounded number of rows each. A slice is
one task's work at a time; inside it the candidates are sorted by norm and cut into buckets. By Cauchy and Schwarz no score in a bucket
exceeds the anchor's norm times the bucket's largest, so an anchor is done with a slice when that falls below what still counts for it: the
lower limit of its window, or the score of the k-th best found so far. The same bound keeps anchors from being sent to slices at all.

The search runs twice. First each anchor reads the slices of its own label, for its positives (a window without limits). Then each score of
a positive is a window [least share of it, itself], and the anchor reads the slices of other labels for all its windows at once.

Scores are exact: integers of a product below 2**53 are multiplied as doubles, larger ones as 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import written

#: Numbers (rows times dimensions) and rows of a slice, about; rows of a slice where there are partitions for more; rows of a bucket; anchors at once.
NUMBERS, MOST, LEAST, BUCKET, BLOCK = 1 << 23, 131_072, 8_192, 1_024, 64
#: Norms are doubles: what rounding may take from a bound.
SLACK = 1 + 1e-9
ROW = "uid long, id long, label string, d int, norm double, v array<long>"


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as double; null if the vector is null or a component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _blocks(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, places, vectors) of an Arrow column of lists without nulls."""
    start = column.offsets.to_numpy()
    size, flat, at = np.diff(start), column.flatten().to_numpy(), start[:-1] - start[0]
    return [(int(d), x, flat[at[x][:, None] + np.arange(d)]) for d in np.unique(size) for x in [np.flatnonzero(size == d)]]


class Slice:
    """Candidates of one number of dimensions, by norm from large to small, in buckets."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, vectors: np.ndarray):
        order = np.argsort(-norms, kind="stable")
        self.uid, self.ids, self.norms, self.vectors = (x[order] for x in (uid, ids, norms, vectors))
        self.numbers = {x: k for k, x in enumerate(sorted(set(labels)))}
        self.labels = self.coded(labels)[order]
        self.doubles = self.vectors.astype(float)
        self.read = 0  # products made, for tests of the pruning

    def coded(self, labels: np.ndarray) -> np.ndarray:
        """The labels as numbers of this slice, -1 for those it doesn't hold."""
        return np.array([self.numbers.get(x, -1) for x in labels], np.int64)

    def scores(self, anchors: np.ndarray, norm: float, a: int, b: int) -> np.ndarray:
        if norm * self.norms[a] * SLACK < 2**53:  # bounds every partial sum
            return (anchors.astype(float) @ self.doubles[a:b].T).astype(np.int64)
        return anchors @ self.vectors[a:b].T

    def best(self, uid: np.ndarray, labels: np.ndarray, norms: np.ndarray, anchors: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, ...]:
        """(window's number, candidate's number, score): the k best candidates of each window, ties to the smaller id, then row.

        Window q belongs to the anchor ``owner[q]`` and takes scores from ``low[q]`` to ``high[q]``; ``same`` tells whether candidates have
        the anchor's label, or another one.
        """
        n = len(owner)
        least, least_id, least_uid = low.copy(), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
        found = tuple(np.zeros(0, np.int64) for _ in range(3))
        for a in range(0, len(self.ids), BUCKET):
            b = min(a + BUCKET, len(self.ids))
            windows = np.flatnonzero(norms[owner] * (self.norms[a] * SLACK) + 1e-6 >= least)
            if not len(windows):
                break  # later buckets have smaller norms
            live, of = np.unique(owner[windows], return_inverse=True)
            score = self.scores(anchors[live], float(norms[live].max()), a, b)
            self.read += score.size
            fits = (labels[live][:, None] == self.labels[None, a:b]) == same
            fits &= uid[live][:, None] != self.uid[None, a:b]
            s, bound = score[of], least[windows][:, None]
            # of those that tie with the k-th, only such that come before it
            before = (self.ids[None, a:b] < least_id[windows][:, None]) | ((self.ids[None, a:b] == least_id[windows][:, None]) & (self.uid[None, a:b] < least_uid[windows][:, None]))
            q, c = np.nonzero(fits[of] & (s <= high[windows][:, None]) & ((s > bound) | ((s == bound) & before)))
            if not len(q):
                continue
            found = tuple(np.concatenate(x) for x in zip(found, (windows[q], c + a, s[q, c]), strict=True))
            order = np.lexsort((self.uid[found[1]], self.ids[found[1]], -found[2], found[0]))
            found = tuple(x[order] for x in found)
            place = np.arange(len(order)) - np.searchsorted(found[0], found[0])
            found = tuple(x[place < k] for x in found)
            last = np.flatnonzero((np.arange(len(found[0])) - np.searchsorted(found[0], found[0])) == k - 1)
            w = found[0][last]
            least[w], least_id[w], least_uid[w] = found[2][last], self.ids[found[1][last]], self.uid[found[1][last]]
        return found


def _search(placed: DataFrame, asked: DataFrame, slices: list, same: bool, k: int, partitions: int) -> DataFrame:
    """(uid, anchor_id, high, other_id, other_uid, score): of each slice the k best rows for each window of each row of ``asked``: the columns
    of ROW, low and high."""
    spark = placed.sparkSession
    known = spark.sparkContext.broadcast(slices)  # one row for each slice
    schema = f"slice int, kind int, {ROW}, low array<long>, high array<long>"

    def deal(batches):
        rows = known.value
        group0, group1 = np.array([r.group0 for r in rows], np.int64), np.array([r.group1 for r in rows], np.int64)
        number, most = np.array([r.slice for r in rows], np.int32), np.array([r.norm for r in rows])
        only = np.array([r.label0 if r.label0 == r.label1 else None for r in rows], object)
        for part in batches:
            names = {name: k for k, name in enumerate(part.schema.names)}
            group, norm = part.column(names["group"]).to_numpy(), part.column(names["norm"]).to_numpy()
            label, low = np.array(part.column(names["label"]).to_pylist(), object), part.column(names["low"]).to_pylist()
            row, place = [], []
            for i in range(part.num_rows):
                if same:
                    here = np.flatnonzero((group0 <= group[i]) & (group[i] <= group1))
                else:
                    here = np.flatnonzero((most * (norm[i] * SLACK) + 1e-6 >= min(low[i])) & (only != label[i]))
                row += [i] * len(here)
                place += number[here].tolist()
            for a in range(0, len(row), 4_096):
                some = pa.array(row[a : a + 4_096], pa.int64())
                columns = [part.column(names[name]).take(some) for name in ("uid", "id", "label", "d", "norm", "v", "low", "high")]
                yield pa.RecordBatch.from_arrays([pa.array(place[a : a + 4_096], pa.int32()), pa.array(np.ones(len(some), np.int32)), *columns], ["slice", "kind", "uid", "id", "label", "d", "norm", "v", "low", "high"])

    none = F.lit(None).cast("array<long>")
    held = placed.select("slice", F.lit(0).alias("kind"), "uid", "id", "label", "d", "norm", "v", none.alias("low"), none.alias("high"))
    dealt = held.unionByName(asked.select("group", "uid", "id", "label", "d", "norm", "v", "low", "high").mapInArrow(deal, schema))
    dealt = dealt.repartition(partitions, "slice").sortWithinPartitions("slice", "kind")

    def run(batches):
        now, held, built = None, [], {}
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (kind[1:] != kind[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(number)), strict=True):
                if number[a] != now:
                    now, held, built = number[a], [], None
                uid, ids, norms = (batch.column(j).slice(a, b - a).to_numpy() for j in (2, 3, 6))
                labels = np.array(batch.column(4).slice(a, b - a).to_pylist(), object)
                groups = _blocks(batch.column(7).slice(a, b - a))
                if kind[a] == 0:
                    held += [(d, uid[x], ids[x], labels[x], norms[x], v) for d, x, v in groups]
                    continue
                if built is None:
                    built = {d: Slice(*(np.concatenate([h[j] for h in held if h[0] == d]) for j in range(1, 6))) for d in {h[0] for h in held}}
                    held = []
                low, high = (batch.column(j).slice(a, b - a).to_pylist() for j in (8, 9))
                for d, x, v in groups:
                    if d not in built:
                        continue
                    for y in np.array_split(np.arange(len(x)), -(-len(x) // BLOCK)):
                        z = x[y]
                        owner = np.repeat(np.arange(len(z)), [len(low[i]) for i in z])
                        lows, highs = (np.array([t for i in z for t in of[i]], np.int64) for of in (low, high))
                        q, c, score = built[d].best(uid[z], built[d].coded(labels[z]), norms[z], v[y], owner, lows, highs, same, k)
                        i = z[owner[q]]
                        yield pa.RecordBatch.from_arrays([pa.array(t) for t in (uid[i], ids[i], highs[q], built[d].ids[c], built[d].uid[c], score)], ["uid", "anchor_id", "high", "other_id", "other_uid", "score"])

    found = dealt.mapInArrow(run, "uid long, anchor_id long, high long, other_id long, other_uid long, score long")
    order = Window.partitionBy("uid", "high").orderBy(F.desc("score"), "other_id", "other_uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "v", positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a row of ``rows`` where ``anchors``, a
    condition on them, holds) and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other labels whose
    score lies between ``share`` (numerator, denominator) of the positive's and the positive's. The score of two rows is the inner product of
    their vectors of whole numbers; larger ones come first, ties by the smaller id.

    Rows without id, label or vector, or with a null in the vector, take no part. Vectors meet those of as many dimensions. Repeated rows
    are rows of their own, also as anchors; an anchor is never its own positive. An anchor without positives, and a positive without
    negatives (one of a score below 0 among them, whose window is empty), have no rows. Other columns of ``rows`` are not read. Empty tables
    give no rows. A pair whose norms multiply to 2**62 or more ends the query with an error.
    """
    spark = rows.sparkSession
    up, down = share
    if not 0 <= up < down:
        raise ValueError("share is a part of the positive's score, from 0 to less than 1")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    good = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<long>").alias("v"), anchors.alias("anchor"))
    good = good.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL)")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    good = good.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "v", F.size("v").alias("d"), norm.alias("norm"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    good = written(good.withColumn("group", F.xxhash64("label", "d")))
    n, widest, longest = good.agg(F.count("*"), F.max("d"), F.max("norm")).first()
    if (longest or 0) ** 2 * SLACK >= 2**62:
        raise ValueError("inner products of these vectors may exceed 64 bits")
    most = max(1, min(MOST, NUMBERS // max(1, widest or 1)))
    wanted = max(-(-n // most), min(partitions, -(-n // LEAST)), 1)
    # equal norms are split by a hash of the row, so that no slice grows with the copies of a vector
    placed = written(good.repartitionByRange(wanted, "group", F.desc("norm"), F.xxhash64("uid")).withColumn("slice", F.spark_partition_id()))
    about = placed.groupBy("slice").agg(F.min("group").alias("group0"), F.max("group").alias("group1"), F.min("label").alias("label0"), F.max("label").alias("label1"), F.max("norm").alias("norm"))
    slices = about.collect()  # a row for each slice: one for about 100,000 candidates
    dealt = max(1, min(partitions, len(slices)))
    one = lambda x: F.array(F.lit(x).cast("long"))
    asked = placed.where("anchor").select("*", one(-(2**63)).alias("low"), one(2**63 - 1).alias("high"))
    found = _search(placed, asked, slices, True, positives, dealt)
    near = written(found.select("uid", "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0"))
    windows = near.groupBy("uid").agg(F.collect_set("positive_score").alias("high"))  # as many as an anchor has positives, at most
    # the least whole number that is not below the share
    windows = windows.withColumn("low", F.expr(f"transform(high, s -> {up}L * (s DIV {down}L) + ({up}L * (s % {down}L) + {down - 1}L) DIV {down}L)"))
    found = _search(placed, placed.where("anchor").join(windows, "uid"), slices, False, negatives, dealt)
    found = found.select("uid", F.col("high").alias("positive_score"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(found, ["uid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
