"""Tables that change are snapshots: each operation gives the new rows, and what it dropped where that is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def update(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the named columns taken from ``changes`` where these have a value; other columns of ``changes`` are ignored."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    rows = df.join(new, key, "left")
    return rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in df.columns])


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def upsert(df: DataFrame, new: DataFrame, keys: list[str], latest: Column | None = None) -> DataFrame:
    """Of rows with one key the new one wins; of several new ones the last by ``latest``."""
    rows = df.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [F.desc("_new"), *([latest] if latest is not None else [])]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_new", "_k")


def insert_missing(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows are added where their key isn't there yet."""
    return df.unionByName(new.join(df.select(*keys), keys, "left_anti").select(*df.columns))


def numbered(df: DataFrame, new: DataFrame, group: str, number: str, order: list[Column]) -> DataFrame:
    """New rows with numbers that go on after the largest of their group, or from 0."""
    last = df.groupBy(group).agg(F.max(number).alias("_last"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return new.join(last, group, "left").withColumn(number, (F.coalesce("_last", F.lit(-1)) + place).cast("long")).drop("_last")


def next_batch(rows: DataFrame, done: DataFrame, id: str, n: int) -> DataFrame:
    """The next ``n`` rows by ``id`` after what ``done`` (one row, last_id, null at the beginning) says; a scan that stopped goes on from there."""
    last = F.broadcast(done.select("last_id"))  # one row
    return rows.crossJoin(last).where(F.col("last_id").isNull() | (F.col(id) > F.col("last_id"))).drop("last_id").orderBy(id).limit(n)


def checkpoint(batch: DataFrame, done: DataFrame, id: str) -> DataFrame:
    """(last_id, processed) after a batch: one row, that of ``done`` if the batch is empty."""
    new = batch.agg(F.max(id).alias("_last"), F.count("*").alias("_n"))
    return done.crossJoin(new).select(F.coalesce("_last", "last_id").alias("last_id"), (F.col("processed") + F.col("_n")).alias("processed"))
