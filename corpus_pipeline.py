"""From documents to packed training windows: quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import jaccard_join, packing, quality, secret_scan
from tidepool.llm.common import discard, table, written

#: Dropped ids up to this number (16 bytes each) are broadcast; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from labels of this stage's input, doesn't reject."""
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, trees, to="_score").where("_score >= 0.5").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar 5-word shingles (0.8 or more) connect, that of the least doc_id. Of rows that share a doc_id
    one stays (the least); rows without doc_id and documents without words stay."""
    groups = written(jaccard_join.join_components(docs, k=5, num=4, den=5).select("doc_id", "component_id"))
    rest = groups.where("component_id <> doc_id").select("doc_id").distinct()
    few = rest.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(rest) if few else rest, "doc_id", "left_anti").select(*docs.columns)
    if groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    one = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*kept.columns)).alias("d")).select("d.*")
    return one.unionByName(kept.where("doc_id IS NULL"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each_group), ("secrets", without_secrets), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, read = written(stage(spark, docs, sf_dir)), before
        before = docs
        if read is not None:
            discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
