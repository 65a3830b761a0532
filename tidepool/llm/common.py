"""What several operators of this subpackage share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession

#: The key of hashes of words; places of a word that the key has random numbers for.
HASH_KEY, PLACES = 5, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of whole texts at most: some megabytes, as texts go.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's number of rows of an Arrow batch (10,000 by default) to ``BATCH_ROWS``: a batch of whole texts is in the memory of
    Spark and of Python at once, several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def mix(h: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits, mixed one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _places() -> np.ndarray:
    return np.random.default_rng(HASH_KEY).integers(0, 1 << 64, PLACES, dtype=np.uint64)


def keyed_hashes(values: np.ndarray, start: np.ndarray, size: np.ndarray, whole: Callable[[int], bytes]) -> np.ndarray:
    """A hash of each run of ``values`` (from 1 on): their sum times random numbers, one for each place, mixed with its length.

    A keyed universal family: whatever the runs, two collide only under few keys, about one in 2**(64 - b) where values differ by
    less than 2**b. A run of more than 4,096 values is hashed by BLAKE2b, from its bytes as ``whole`` gives them.
    """
    found = np.zeros(len(start), np.uint64)
    short = np.flatnonzero(size <= PLACES)
    if len(short):
        first, n = start[short], size[short]
        before = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(before, n)
        found[short] = np.add.reduceat(values[place + np.repeat(first, n)] * _places()[place], before)
    for k in np.flatnonzero(size > PLACES).tolist():
        found[k] = int.from_bytes(hashlib.blake2b(whole(k), digest_size=8).digest(), "little")
    return mix(found + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that ``spark.checkpoint.dir`` names, which all executors share. Only a session of one machine goes on without."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidepool-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder; Spark removes it later if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than a checkpoint, and read by columns. Removed with the session, or by ``discard``."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._path = path
    atexit.register(discard, table)
    return table


def few_jobs(df: DataFrame) -> Iterator[Row]:
    """The rows of a ``df`` of bounded size, some of them at the driver at once. ``toLocalIterator`` runs a job for each partition, so rows are dealt to few."""
    return df.repartition(8).toLocalIterator()


def discard(df: DataFrame) -> None:
    """Removes what ``written`` wrote. Nothing that is still to be computed may need it."""
    sc = df.sparkSession.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        path = sc._jvm.org.apache.hadoop.fs.Path(df._path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
