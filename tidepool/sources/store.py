"""Tables that change in place, by parts: a change reads and writes the parts that its keys lie in, and no other file.

A table is a folder of Parquet with one part for each range of ``width`` keys (whole numbers): part = floor(key / width). Ranges stay where they are
as keys are added. A change is computed from the parts that it touches, kept in the shared folder, and written over these by Spark's dynamic
overwrite. Each part is replaced as a whole; a change that was lost halfway can be made again, and has then been made once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import snapshots
from tidepool.operators.graph import cut
from tidepool.sources.files import exists, remove

PART = "_part"


@dataclass
class Table:
    spark: SparkSession
    path: str
    key: str
    width: int

    def part(self) -> Column:
        return F.floor(F.col(self.key) / self.width).cast("long")

    def _write(self, rows: DataFrame, mode: str) -> None:
        """One file for each part, or several for one of many rows, as adaptive execution finds."""
        rows = rows.withColumn(PART, self.part())
        rows.hint("rebalance", PART).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Writes a new table. Rows without a key can't be found again, so they are an error."""
        self._write(rows.withColumn(self.key, F.coalesce(F.col(self.key), F.raise_error(F.lit("a row without key")).cast(dict(rows.dtypes)[self.key]))), "errorifexists")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(PART)

    def touched(self, keys: DataFrame) -> tuple[DataFrame, list[int]]:
        """(rows of the parts that keys lie in, these parts): folders of other parts are pruned before a file is opened."""
        parts = [r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self.part().alias(PART)).distinct().collect()]  # one number for each part to be rewritten
        return self.spark.read.parquet(self.path).where(F.col(PART).isin(parts)), parts

    def _change(self, keys: DataFrame, make) -> int:
        """Replaces the touched parts by what ``make`` does with their rows; returns how many parts there are of them."""
        old, parts = self.touched(keys)
        if not parts:
            return 0
        new = cut(make(old.drop(PART)))
        kept = {r[0] for r in new.select(self.part().alias(PART)).distinct().collect()}
        if kept:
            self._write(new, "overwrite")
        for part in parts:  # those without rows now: overwriting wouldn't touch them
            if part not in kept:
                remove(self.spark, f"{self.path}/{PART}={part}")
        return len(parts)

    def upsert(self, new: DataFrame, latest: Column | None = None) -> int:
        """Rows of new keys are added, those of known keys replaced; of several new ones of one key the first by ``latest`` counts."""
        new = new.where(F.col(self.key).isNotNull())
        return self._change(new, lambda old: snapshots.upsert(old, new.select(*old.columns), [self.key], latest))

    def insert_missing(self, new: DataFrame) -> int:
        """Rows of new keys are added (one of each), known keys stay as they are."""
        new = new.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        return self._change(new, lambda old: snapshots.insert_missing(old, new.select(*old.columns), [self.key]))

    def update(self, changes: DataFrame, columns: list[str]) -> int:
        """The named columns of known keys, where the change (one row for each key) has a value."""
        return self._change(changes, lambda old: snapshots.update(old, changes.dropDuplicates([self.key]), self.key, columns))

    def delete(self, ids: DataFrame) -> int:
        return self._change(ids, lambda old: snapshots.delete(old, ids.distinct(), self.key))


class Scan:
    """A scan by ranges of an id that a later session goes on with: the ranges are written down before it begins, and each is noted when its result
    is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def plan(self, rows: DataFrame, id: str, size: int) -> None:
        """Writes down ranges of about ``size`` rows each, unless that was done before. ``rows`` that come later belong to the last range."""
        if exists(self.spark, f"{self.folder}/ranges/_SUCCESS"):
            return
        n = rows.where(F.col(id).isNotNull()).count()
        shares = [k / -(-n // size) for k in range(1, -(-n // size))]
        ends = sorted(set(rows.agg(F.percentile_approx(id, shares)).first()[0] or [])) if shares else []
        low = [None, *ends]
        ranges = [(k, a, b) for k, (a, b) in enumerate(zip(low, [*ends, None], strict=True))]  # one row for each ``size`` rows
        self.spark.createDataFrame(ranges, "range int, low long, high long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ranges")

    def pending(self) -> list:
        done = [r[0] for r in self.spark.read.schema("range int").parquet(f"{self.folder}/done").collect()] if exists(self.spark, f"{self.folder}/done") else []
        return [r for r in self.spark.read.parquet(f"{self.folder}/ranges").orderBy("range").collect() if r.range not in set(done)]

    def run(self, rows: DataFrame, id: str, work, most: int | None = None) -> int:
        """Works on the next ranges (all, or ``most``), each written by its number, so that one that was lost halfway is written anew. Returns how
        many are left."""
        left = self.pending()
        for r in left[:most]:
            some = rows.where(F.lit(True) if r.low is None else F.col(id) > r.low).where(F.lit(True) if r.high is None else F.col(id) <= r.high)
            work(some).write.mode("overwrite").parquet(f"{self.folder}/found/range={r.range}")
            self.spark.createDataFrame([(r.range,)], "range int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done/number={r.range}")
        return max(0, len(left) - (len(left) if most is None else most))

    def found(self) -> DataFrame:
        """The results of the ranges that are done, with the column range."""
        done = self.spark.read.schema("range int").parquet(f"{self.folder}/done")
        return self.spark.read.parquet(f"{self.folder}/found").join(done, "range", "left_semi")
