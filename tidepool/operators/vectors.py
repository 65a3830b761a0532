"""Pairs of vectors whose cosine reaches a threshold, with pairs of cells left out by the triangle inequality.

Angles between vectors are distances. Each vector belongs to the cell of its nearest pivot, and the rows of a cell are sorted by their angle to it and
cut into blocks: rings around the pivot, of bounded size. A vector that is at an angle of p from a pivot has no vector within t of it in a ring from
a to b if p + t < a or p - t > b. So it is sent only to rings that it may have partners in, and what is left out is left out exactly: which
vectors are pivots decides what is compared, never what is found. Vectors without clusters, and low thresholds, leave out little.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.graph import cut

#: Rows and numbers (rows times dimensions) of a block at most; rows of a block where there are partitions for more.
MOST, NUMBERS, LEAST = 16_384, 1 << 21, 1_024
#: Pivots at most, and numbers of all of them; rows that they are chosen from, about; visitors at once.
PIVOTS, PIVOT_NUMBERS, SAMPLE, CHUNK = 1_024, 1 << 21, 4_096, 1_024
#: What rounding may take from an angle, and from a cosine.
SLACK, ROUNDING = 1e-6, 1e-9
#: Norms below count as nothing.
TINY = 1e-10


def _by_size(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, places, vectors) of an Arrow column of lists without nulls."""
    start = column.offsets.to_numpy()
    size, flat, at = np.diff(start), column.flatten().to_numpy(zero_copy_only=False), start[:-1] - start[0]
    return [(int(d), x, flat[at[x][:, None] + np.arange(d)]) for d in np.unique(size) for x in [np.flatnonzero(size == d)]]


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n unit vectors, each the farthest of the sample from those before it."""
    found = [0]
    near = sample @ sample[0]
    while len(found) < min(n, len(sample)):
        found.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[found[-1]])
    return sample[found]


class Pivots:
    """Pivots of each number of dimensions; cells are numbered through all of them."""

    def __init__(self, samples: dict[int, np.ndarray], cells: int):
        self.of, self.first, n = {}, {}, 0
        for d, sample in sorted(samples.items()):
            self.of[d] = _spread(sample, max(1, min(cells, PIVOT_NUMBERS // max(1, d))))
            self.first[d] = n
            n += len(self.of[d])
        self.cells = n

    def angles(self, unit: np.ndarray) -> tuple[int, np.ndarray]:
        """(number of the first cell, angles to all pivots); without pivots of these dimensions, one for all at no distance."""
        d = unit.shape[1]
        if d not in self.of:
            return self.cells, np.zeros((len(unit), 1))
        return self.first[d], np.arccos(np.clip(unit @ self.of[d].T, -1, 1))


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def _usable(vectors: DataFrame, id: str, embedding: str) -> DataFrame:
    rows = vectors.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite).where(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)) >= TINY)


def visits(vectors: DataFrame, least: float, queries: DataFrame | None = None, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(block, kind, own, id, v): the residents of each block (kind 0), and the rows that visit it (kind 1): of ``queries`` all that may have partners
    there; without them, each row visits such blocks behind its own. ``near_vectors`` compares them."""
    spark = vectors.sparkSession
    rows = _usable(vectors, id, embedding)
    n, widest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(MOST, NUMBERS // (widest or 1)))
    blocks = max(1, -(-n // most), min(partitions, -(-n // LEAST)))
    sample = rows.select("v").sample(min(1.0, SAMPLE / max(1, n)), seed=0).limit(2 * SAMPLE).toPandas()["v"]
    sizes = sample.map(len)
    known = {int(d): _units(np.stack(sample[sizes == d].to_list())) for d in set(sizes)}
    pivots = spark.sparkContext.broadcast(Pivots(known, min(PIVOTS, -(-n // LEAST))))  # PIVOT_NUMBERS numbers for each number of dimensions

    def place(batches):
        for part in batches:
            cell, angle = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows)
            for _, x, v in _by_size(part.column(1)):
                first, angles = pivots.value.angles(_units(v))
                near = angles.argmin(1)
                cell[x], angle[x] = first + near, angles[np.arange(len(x)), near]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell), pa.array(angle)], ["id", "v", "cell", "angle"])

    schema = f"id {dict(rows.dtypes)['id']}, v array<double>"
    placed = rows.mapInArrow(place, f"{schema}, cell int, angle double")
    # rows at one angle, such as copies of a vector, are split by their ids
    placed = cut(placed.repartitionByRange(blocks, "cell", "angle", F.xxhash64("id")).withColumn("block", F.spark_partition_id()))
    rings = placed.groupBy("cell", "block").agg(F.min("angle").alias("a"), F.max("angle").alias("b")).orderBy("cell", "block").collect()  # as many as blocks and cells
    table = {}
    for r in rings:
        table.setdefault(r.cell, []).append((r.block, r.a, r.b))
    table = spark.sparkContext.broadcast({c: tuple(map(np.array, zip(*x, strict=True))) for c, x in table.items()})
    reach = float(np.arccos(np.clip(least, -1, 1))) + SLACK

    def deal(batches):
        for part in batches:
            own = part.column(2).to_numpy()
            row, to = [], []
            for _, x, v in _by_size(part.column(1)):
                first, angles = pivots.value.angles(_units(v))
                pairs = []
                for k in range(angles.shape[1]):
                    if first + k not in table.value:
                        continue
                    block, a, b = table.value[first + k]  # sorted by angle
                    low, high = np.searchsorted(b, angles[:, k] - reach), np.searchsorted(a, angles[:, k] + reach, side="right")
                    size = np.maximum(high - low, 0)
                    some = np.repeat(np.arange(len(x)), size)
                    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
                    pairs.append((x[some], block[place]))
                for a, b in pairs:
                    later = b > own[a]
                    row.append(a[later])
                    to.append(b[later])
            row, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, to))
            if len(row):  # a block may have rings of several cells
                row, to = np.unique(np.stack([row, to]), axis=1)
            for k in range(0, len(row), 4_096):
                some = pa.array(row[k : k + 4_096].astype(np.int64))
                one = pa.array(np.ones(len(some), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(to[k : k + 4_096].astype(np.int32)), one, part.column(2).take(some), part.column(0).take(some), part.column(1).take(some)], ["block", "kind", "own", "id", "v"])

    asked = placed.select("id", "v", "block") if queries is None else _usable(queries, id, embedding).select("id", "v", F.lit(-1).alias("block"))
    visitors = asked.mapInArrow(deal, f"block int, kind int, own int, {schema}")
    return placed.select("block", F.lit(0).alias("kind"), F.col("block").alias("own"), "id", "v").unionByName(visitors)


def near_vectors(vectors: DataFrame, least: float, queries: DataFrame | None = None, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(a, b, similarity) of pairs of vectors whose cosine reaches ``least``: all pairs a < b, or, with ``queries``, pairs of a row a of these and
    a row b of ``vectors`` (also of one id). Vectors of different sizes pair with none, nor do null ones, such with null or non-finite
    components, zero vectors and rows without id. Exact, in double precision."""
    spark = vectors.sparkSession
    dealt, alone = visits(vectors, least, queries, id, embedding), queries is None
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "kind")

    def pairs(v, ids, w, others, inside):
        close = _units(v) @ _units(w).T >= least - ROUNDING
        a, b = np.nonzero(np.triu(close, 1) if inside else close)
        similarity = np.einsum("ij,ij->i", v[a], w[b]) / np.sqrt(np.einsum("ij,ij->i", v[a], v[a]) * np.einsum("ij,ij->i", w[b], w[b]))
        keep = similarity >= least
        left, right = ids[a], others[b]
        if alone:
            keep &= left != right
            left, right = np.minimum(left, right), np.maximum(left, right)
        return pa.RecordBatch.from_arrays([pa.array(left[keep]), pa.array(right[keep]), pa.array(similarity[keep])], ["a", "b", "similarity"])

    def compare(batches):
        now, held = None, {}
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(block)), strict=True):
                if block[a] != now:
                    now, held = block[a], {}
                ids = batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False)
                for d, x, v in _by_size(batch.column(4).slice(a, b - a)):
                    for y in np.array_split(np.arange(len(x)), -(-len(x) // CHUNK)):
                        for w, others in held.get(d, ()):
                            if kind[a] == 1 or alone:
                                yield pairs(v[y], ids[x[y]], w, others, False)
                        if kind[a] == 0:
                            if alone:
                                yield pairs(v[y], ids[x[y]], v[y], ids[x[y]], True)
                            held.setdefault(d, []).append((v[y], ids[x[y]]))

    kind = dict(_usable(vectors, id, embedding).dtypes)["id"]
    return dealt.mapInArrow(compare, f"a {kind}, b {kind}, similarity double")
