"""Vectors stored by cells, so that a query by one vector opens few files, exactly.

Vectors belong to the cell of their nearest pivot, as in ``vectors``, and each cell is cut into rings by the angle to it. A ring is a part of the table,
and a small table has each ring's least and greatest angle. By the triangle inequality a ring from a to b holds nothing nearer to a query than the
distance of the query's angle to the pivot from the range [a, b]. A search reads the rings with the best bounds, and then those whose bound
reaches what the k-th best found so far has; rings that are left can hold none of the k best. Cosine and distance alike: larger cosines are smaller angles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import scores
from tidepool.operators.graph import cut
from tidepool.operators.vectors import LEAST, NUMBERS, PIVOTS, SAMPLE, SLACK, Pivots, _by_size, _units, _usable

#: Rings that a search reads first, and how many times more each time after that.
FIRST, MORE = 4, 4


@dataclass
class Index:
    spark: SparkSession
    path: str
    id: str = "vec_id"
    embedding: str = "embedding"

    def build(self, vectors: DataFrame, size: int = 4_096) -> None:
        """Writes the vectors that can be near one (``vectors._usable``: with an id, not null, of finite components, not zero) in rings of about ``size``."""
        rows = _usable(vectors, self.id, self.embedding)
        n, widest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        rings = max(1, -(-n // max(1, min(size, NUMBERS // (widest or 1)))))
        sample = rows.select("v").sample(min(1.0, SAMPLE / max(1, n)), seed=0).limit(2 * SAMPLE).toPandas()["v"]
        sizes = sample.map(len)
        known = {int(d): _units(np.stack(sample[sizes == d].to_list())) for d in set(sizes)}
        made = Pivots(known, min(PIVOTS, -(-n // min(size, LEAST)) if n else 1))
        pivots = self.spark.sparkContext.broadcast(made)

        def place(batches):
            for part in batches:
                cell, angle = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows)
                for _, x, v in _by_size(part.column(1)):
                    first, angles = pivots.value.angles(_units(v))
                    near = angles.argmin(1)
                    cell[x], angle[x] = first + near, angles[np.arange(len(x)), near]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell), pa.array(angle)], ["id", "v", "cell", "angle"])

        placed = rows.mapInArrow(place, f"id {dict(rows.dtypes)['id']}, v array<double>, cell int, angle double")
        # rows at one angle are split by their ids
        placed = cut(placed.repartitionByRange(rings, "cell", "angle", F.xxhash64("id")).withColumn("ring", F.spark_partition_id()))
        placed.write.mode("overwrite").partitionBy("ring").parquet(f"{self.path}/vectors")
        about = placed.groupBy("ring", "cell", F.size("v").alias("d")).agg(F.min("angle").alias("a"), F.max("angle").alias("b"), F.count("*").alias("n"))
        about.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/rings")
        rows = [(d, made.first[d] + k, [float(x) for x in p]) for d, every in made.of.items() for k, p in enumerate(every)]
        self.spark.createDataFrame(rows, "d int, cell int, pivot array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pivots")

    def bounds(self, query: list[float]) -> tuple[list[tuple[float, int]], int]:
        """([(least angle that a ring can have to the query, ring)], the nearest first; rings of all). One row of a ring and of a pivot comes to the driver."""
        unit = np.array(query, float) / np.linalg.norm(query)
        pivots = {r.cell: np.array(r.pivot) for r in self.spark.read.parquet(f"{self.path}/pivots").where(F.col("d") == len(query)).collect()}
        rings = self.spark.read.parquet(f"{self.path}/rings").collect()
        best: dict[int, float] = {}
        for r in rings:
            if r.d == len(query):
                p = float(np.arccos(np.clip(unit @ pivots[r.cell], -1, 1))) if r.cell in pivots else None
                bound = 0.0 if p is None else max(0.0, r.a - p, p - r.b) - SLACK
                best[r.ring] = min(best.get(r.ring, np.inf), bound)
        return sorted((bound, ring) for ring, bound in best.items()), len({r.ring for r in rings})

    def scored(self, rings: list[int], query: list[float]) -> DataFrame:
        """(id, similarity) of the vectors of some rings: folders of others are not opened."""
        rows = self.spark.read.parquet(f"{self.path}/vectors").where(F.col("ring").isin(rings) & (F.size("v") == len(query)))
        return rows.select(F.col("id").alias(self.id), scores.cosine(F.col("v"), F.array(*map(F.lit, query))).alias("similarity"))

    def nearest(self, query: list[float], k: int, least: float = -1.0, but: object = None) -> tuple[list, float]:
        """([(id, similarity)] of the k nearest vectors of at least some cosine, ties to the smaller id, without the row of id ``but``; the share of the rings
        that were read). A zero query, one with a null, or an empty one is near nothing."""
        if not query or any(x is None or not np.isfinite(x) for x in query) or not any(query):
            return [], 0.0
        order, every = self.bounds(query)
        found, at, step = [], 0, FIRST
        reach = float(np.arccos(np.clip(least, -1, 1))) + SLACK
        while at < len(order):
            last = float(np.arccos(np.clip(found[k - 1][1], -1, 1))) + SLACK if len(found) >= k else np.inf
            some = [ring for bound, ring in order[at : at + step] if bound <= min(last, reach)]
            if not some:
                break
            rows = self.scored(some, query).where(F.col("similarity") >= least)
            rows = rows.where(F.col(self.id) != F.lit(but)) if but is not None else rows
            best = rows.orderBy(F.desc("similarity"), self.id).limit(k).collect()
            found = sorted([*found, *((r[0], r[1]) for r in best)], key=lambda r: (-r[1], r[0]))[:k]
            at, step = at + len(some), step * MORE
        return found, at / max(1, every)
