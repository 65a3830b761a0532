"""Nearest neighbours by inner product through randomly rotated one-bit codes.

A vector of unit length is rotated at random and keeps one bit a dimension, packed
into words of 64 bits, and one scalar: its inner product f with the corner of the
cube that the bits name. A query is rotated alike and its components are rounded to
four bits, kept as four bit planes, so the inner product of a query and a corner comes
from counted bits. Divided by f it estimates that of the vectors, without bias and
with an error of about sqrt((1 - f * f) / (f * f * (d - 1))), so a multiple of that
bounds it. A candidate is scored exactly if its upper bound reaches what the 20th of
the best exact scores so far has; others can't be among the nearest but by an error
beyond the bound.

An index keeps queries from reading all codes: vectors belong to the cell of the nearest
of some directions, which k-means learns from a bounded sample (``SAMPLE`` rows, the
least by a hash). Each query reads the cells whose mean vectors have the largest inner
products with it; how many, a part of the sample tells, so that ``recall`` of its true
neighbours lie in them: few where vectors have clusters, more than half where they have
none. All rows are in the index. Neighbouring cells lie in one part of bounded size, and
cells of more rows in several; a query goes once to each part that has cells for it, reads
those cells there, and the best of each part meet in one sort per query.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import mix

#: Numbers (rows times dimensions) and rows of a part at most, rows of a part where there are partitions for more; rows of a cell, about; cells at most.
NUMBERS, MOST, LEAST, CELL, CELLS = 1 << 23, 65_536, 8_192, 1_024, 512
#: Rows that the cells are learned from, and queries that tell how many of them to read; the share of neighbours to be in these.
SAMPLE, TRIALS, RECALL = 20_000, 300, 0.97
#: Errors of an estimate that its bound allows for; bits of a query's components; queries at once.
BOUND, QUERY_BITS, BLOCK = 1.9, 4, 64
U = np.uint64


@lru_cache(8)
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return packed.view(U)


class Codes:
    """The candidates of one part with one number of dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.d = vectors.shape[1]
        self.norms = np.sqrt((vectors * vectors).sum(1))
        rotated = (vectors / self.norms[:, None]) @ rotation(self.d)
        self.words = _words(rotated > 0)
        self.ones = np.bitwise_count(self.words).sum(1).astype(np.float32)
        self.f = np.abs(rotated).sum(1) / np.sqrt(self.d)
        self.error = np.sqrt(np.maximum(0.0, 1 - self.f**2) / (self.f**2 * max(1, self.d - 1)))

    def estimates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products, what they may be wrong by) of queries and candidates."""
        norms = np.sqrt((queries * queries).sum(1))
        rotated = (queries / norms[:, None]) @ rotation(self.d)
        low = rotated.min(1)
        step = np.maximum((rotated.max(1) - low) / ((1 << QUERY_BITS) - 1), 1e-12)
        levels = np.rint((rotated - low[:, None]) / step[:, None]).astype(np.int64)
        total = np.zeros((len(queries), len(self.ids)), np.float32)
        for bit in range(QUERY_BITS):
            plane = _words((levels >> bit) & 1 > 0)
            for w in range(self.words.shape[1]):
                total += np.bitwise_count(self.words[None, :, w] & plane[:, w, None]) * np.float32(1 << bit)
        inner = (2 * (low[:, None] * self.ones + step[:, None] * total) - rotated.sum(1)[:, None]) / np.sqrt(self.d)
        scale = norms[:, None] * self.norms
        return inner / self.f * scale, BOUND * np.sqrt(self.error**2 + (0.41 * step[:, None] / self.f) ** 2) * scale

    def exact(self, query: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Inner products of a query and some candidates in double precision."""
        return np.einsum("ij,j->i", self.vectors[c], query)

    def nearest(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's number, candidate's number, score) of the k best of this part, ties to the smaller id."""
        estimate, error = self.estimates(queries)
        own = self.ids[None, :] == ids[:, None]
        for q, c in zip(*np.nonzero(own), strict=True):
            own[q, c] = own[q, :c].sum() == 0 and bool((self.vectors[c] == queries[q]).all())
        estimate[own] = -np.inf
        error[own] = 0
        n = min(k, len(self.ids))
        first = np.argpartition(-estimate, n - 1, axis=1)[:, :n]
        upper = estimate + error
        found: list[tuple] = []
        for q in range(len(queries)):
            scores = self.exact(queries[q], first[q][~own[q, first[q]]])
            # the least of k exact scores, less what rounding could take from a tie
            least = scores.min() - 1e-9 * (1 + abs(scores.min())) if len(scores) == k else -np.inf
            upper[q, first[q]] = np.inf
            c = np.flatnonzero((upper[q] >= least) & ~own[q])
            scores = self.exact(queries[q], c)
            best = np.lexsort((self.ids[c], -scores))[:k]
            found.append((np.full(len(best), q), c[best], scores[best]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Cells:
    """Directions that cells are around, their mean vectors, and how many of them a query reads."""

    def __init__(self, sample: np.ndarray, n: int, k: int, recall: float):
        rng = np.random.default_rng(len(sample))
        directions = sample / np.sqrt((sample * sample).sum(1))[:, None]
        cells = int(max(1, min(CELLS, n // CELL, len(sample) // 16)))
        self.centres = directions[rng.choice(len(sample), cells, replace=False)]
        for _ in range(12):
            own = self.of(sample)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, directions)
            size = np.sqrt((sums * sums).sum(1))
            self.centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], self.centres)
        own = self.of(sample)
        counts = np.bincount(own, minlength=cells)
        self.means = np.zeros_like(self.centres)
        np.add.at(self.means, own, sample)
        self.means /= np.maximum(counts, 1)[:, None]
        trials = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
        scores = sample[trials] @ sample.T
        scores[np.arange(len(trials)), trials] = -np.inf
        best = np.argpartition(-scores, min(k, len(sample) - 1) - 1, axis=1)[:, :k] if len(sample) > 1 else np.zeros((len(trials), 1), np.int64)
        order = self.order(sample[trials])
        place = np.empty_like(order)
        place[np.arange(len(trials))[:, None], order] = np.arange(cells)
        depth = np.sort(place[np.arange(len(trials))[:, None], own[best]].reshape(-1))
        self.probes = int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))))]) + 1

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.centres.T).argmax(1)

    def chain(self) -> list[int]:
        """The cells, each followed by the nearest that isn't in the chain yet."""
        near, out = self.centres @ self.centres.T, [0]
        free = np.ones(len(near), bool)
        free[0] = False
        while free.any():
            out.append(int(np.where(free, near[out[-1]], -np.inf).argmax()))
            free[out[-1]] = False
        return out

    def order(self, queries: np.ndarray) -> np.ndarray:
        """The cells of each query, those with the largest inner product of their mean first."""
        return np.argsort(-(queries @ self.means.T), axis=1, kind="stable")


def fit(rows: DataFrame, n: int, k: int = 20, recall: float = RECALL) -> dict[int, Cells]:
    """Cells of each number of dimensions that the sample has, from ``rows`` (id, v) of which there are ``n``."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    sizes = sample.map(len)
    found = {}
    for d in sorted(set(sizes)):
        x = np.stack(sample[sizes == d].to_list()).astype(float)
        found[int(d)] = Cells(x, max(1, n * len(x) // len(sample)), k, recall)
    return found


def packed(counts: dict[tuple[int, int], int], cells: dict[int, Cells], most: int) -> tuple[dict[tuple[int, int], tuple[int, int]], int]:
    """({(dimensions, cell): (first part, number of parts)}, parts) so that a part has ``most`` rows, about: several cells of few rows, or a
    share of one of many. ``counts`` are the cells' rows."""
    found, part, held = {}, 0, 0
    for d in sorted({d for d, _ in counts}):
        known = cells[d].chain() if d in cells else [0]
        for cell in known:
            n = counts.get((d, cell), 0)
            if held and held + n > most:
                part, held = part + 1, 0
            if n > most:
                found[d, cell] = (part, -(-n // most))
                part += found[d, cell][1]
            elif n:
                found[d, cell] = (part, 1)
                held += n
    return found, part + (held > 0)


def _by_size(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, places, vectors) of an Arrow column of lists without nulls."""
    size, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    at = column.offsets.to_numpy()[:-1] - column.offsets.to_numpy()[0]
    return [(int(d), x, flat[at[x][:, None] + np.arange(d)]) for d in np.unique(size) for x in [np.flatnonzero(size == d)]]


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest of those rows of ``vectors`` that it reads, but for its own row (of rows
    with its id and its vector, one).

    Null vectors, zero vectors and such with null or non-finite components take no part, nor do rows without an id; vectors meet
    those of as many dimensions. Ties go to the smaller id. Repeated rows are candidates of their own, and repeated query rows
    have results of their own. With ``recall`` 1 all codes are read.
    """
    spark = vectors.sparkSession

    def good(df: DataFrame) -> DataFrame:
        df = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(finite & F.exists("v", lambda x: x != 0))

    rows, asked = good(vectors), good(queries).withColumn("q", F.monotonically_increasing_id())
    n, widest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(1, min(MOST, NUMBERS // (widest or 1)))
    cells = spark.sparkContext.broadcast(fit(rows, n, k, recall) if n else {})  # 512 times the dimensions at most, and as many means

    def own_cell(parts):
        for part in parts:
            cell = np.zeros(part.num_rows, np.int32)
            size = np.zeros(part.num_rows, np.int32)
            for d, x, v in _by_size(part.column(1)):
                size[x] = d
                if d in cells.value:
                    cell[x] = cells.value[d].of(v)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size), pa.array(cell)], ["id", "v", "d", "cell"])

    placed = rows.mapInArrow(own_cell, "id long, v array<double>, d int, cell int")
    counts = {(r.d, r.cell): r["count"] for r in placed.groupBy("d", "cell").count().collect()}  # one number of each cell
    wanted = max(1, -(-n // most), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST)))
    first, parts = packed(counts, cells.value, -(-n // wanted) if n else 1)
    table = spark.sparkContext.broadcast(first)

    def part_of(batches):
        for part in batches:
            ids, d, cell = (part.column(i).to_numpy() for i in (0, 2, 3))
            mixed = mix(ids.astype(np.int64).view(U))
            begin, size = np.array([table.value[x] for x in zip(d.tolist(), cell.tolist(), strict=True)], np.int64).reshape(-1, 2).T
            place = begin + (mixed % size.astype(U)).astype(np.int64)
            zero = np.zeros(part.num_rows, np.int64)
            own = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32)), part.column(3))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(zero), part.column(0), part.column(1), pa.array(zero), own], ["part", "kind", "id", "v", "q", "cells"])

    def read(batches):
        for part in batches:
            row, place, lists = [], [], []
            for d, x, v in _by_size(part.column(1)):
                known = cells.value.get(d)
                order = known.order(v)[:, : known.probes if recall < 1 else None] if known else np.zeros((len(x), 1), np.int64)
                for i, own in zip(x.tolist(), order.tolist(), strict=True):
                    here: dict[int, list[int]] = {}
                    for c in own:
                        begin, size = table.value.get((d, c), (0, 0))
                        for k in range(begin, begin + size):
                            here.setdefault(k, []).append(c)
                    row += [i] * len(here)
                    place += here
                    lists += here.values()
            for a in range(0, len(row), 10_000):
                some = pa.array(row[a : a + 10_000], pa.int64())
                one = pa.array(np.ones(len(some), np.int64))
                columns = [pa.array(place[a : a + 10_000], pa.int64()), one, *(part.column(k).take(some) for k in range(3)), pa.array(lists[a : a + 10_000], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "kind", "id", "v", "q", "cells"])

    schema = "part long, kind long, id long, v array<double>, q long, cells array<int>"
    dealt = placed.mapInArrow(part_of, schema).unionByName(asked.select("id", "v", "q").mapInArrow(read, schema))
    dealt = dealt.repartition(max(1, min(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))), "part").sortWithinPartitions("part", "kind", "id")

    def run(batches):
        now, held, codes = None, [], None
        for batch in batches:
            part, kind, ids = (batch.column(i).to_numpy() for i in range(3))
            asked_as = batch.column(4).to_numpy()
            cuts = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
                if part[a] != now:
                    now, held, codes = part[a], [], None
                groups, own_cells = _by_size(batch.column(3).slice(a, b - a)), batch.column(5).slice(a, b - a)
                if kind[a] == 0:
                    cell = own_cells.flatten().to_numpy()
                    held += [(d, ids[a + x], v, cell[x]) for d, x, v in groups]
                    continue
                if codes is None:
                    codes = {}
                    for d in {h[0] for h in held}:
                        own, v, cell = (np.concatenate([h[k] for h in held if h[0] == d]) for k in (1, 2, 3))
                        codes |= {(d, int(c)): Codes(own[cell == c], v[cell == c]) for c in np.unique(cell)}
                    held = []
                lists = own_cells.to_pylist()
                for d, x, v in groups:
                    for y in np.array_split(np.arange(len(x)), -(-len(x) // BLOCK)):
                        own, best = ids[a + x[y]], []
                        for c in sorted({c for j in y.tolist() for c in lists[x[j]]}):
                            if (d, c) in codes:
                                some = np.flatnonzero([c in lists[x[j]] for j in y.tolist()])
                                q, at, score = codes[d, c].nearest(own[some], v[y][some], k)
                                best.append((some[q], codes[d, c].ids[at], score))
                        if best:
                            q, vec, score = (np.concatenate(z) for z in zip(*best, strict=True))
                            order = np.lexsort((vec, -score, q))
                            q, vec, score = q[order], vec[order], score[order]
                            kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                            yield pa.RecordBatch.from_arrays([pa.array(z[kept]) for z in (asked_as[a + x[y]][q], own[q], vec, score)], ["q", "query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
