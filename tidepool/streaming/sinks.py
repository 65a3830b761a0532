"""One stream into several tables, each micro-batch once.

A micro-batch is written to every table as a part of its own (``batch=<number>``), which a repetition overwrites, and then entered into a ledger.
What isn't in the ledger isn't read: a batch that failed between two tables is in none of them. A batch that comes again after it was
entered, as when a stream restarts from a checkpoint that is a step behind, writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidepool.sources.files import exists

Sinks = dict[str, Callable[[DataFrame], DataFrame]]


def write_batch(batch: DataFrame, number: int, folder: str, sinks: Sinks) -> bool:
    """Writes one micro-batch into all tables of ``folder`` and enters it; False if it was entered before, and nothing was written."""
    spark = batch.sparkSession
    if exists(spark, f"{folder}/ledger/batch={number}/_SUCCESS"):
        return False
    batch = batch.persist()  # read once from the source for all tables
    try:
        rows = [(name, make(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")) for name, make in sinks.items()]
        entry = spark.createDataFrame([(name,) for name, _ in rows], "sink string").withColumn("at", F.current_timestamp())
        entry.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")
    finally:
        batch.unpersist()
    return True


def fan_out(stream: DataFrame, folder: str, sinks: Sinks) -> DataStreamWriter:
    """A writer of a stream into the tables of ``folder``, each made of a micro-batch by a function; give it a checkpoint and a trigger. A
    function sees one micro-batch: what needs more than that is asked of the table that is written."""
    if not sinks or "ledger" in sinks:
        raise ValueError("tables need names, and ledger is taken")

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, folder, sinks)

    return stream.writeStream.foreachBatch(write)


def entered(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, sink, at) of the batches in the ledger."""
    schema = "sink string, at timestamp, batch long"
    return spark.read.schema(schema).parquet(f"{folder}/ledger") if exists(spark, f"{folder}/ledger") else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as far as the ledger goes, with the column batch."""
    known = entered(spark, folder).where(F.col("sink") == name).select("batch").distinct()
    return spark.read.parquet(f"{folder}/{name}").join(known, "batch", "left_semi")
