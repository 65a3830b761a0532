"""Substring search through a table of runs of three characters, so that a search reads few files.

``build`` writes, for a table of texts, which texts hold which runs (in lower case), by buckets of the run's hash, sorted by run, and the texts themselves by
ranges of ids. A search takes the literal pieces of what it looks for, reads the buckets of their runs, keeps texts that hold all of these, reads
the parts of the texts that are left, and tests the texts themselves: what is found is what a scan finds. What has no piece of three characters is
looked for in all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a run; runs of one search that are looked up, at most, the rarest first: more would hardly leave out more.
RUN, ASKED = 3, 8
#: Ids that are read by a list of parts; beyond, all parts of texts may hold one.
PARTS = 10_000


def runs(text: Column) -> Column:
    """The different runs of a text in lower case, in time that grows with its size: each place is looked ahead from once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{RUN}}}))"), F.lit(1)))


def pieces(pattern: str) -> list[str]:
    """The literal pieces of a LIKE pattern, whose wildcards are % and _ and whose escape is a backslash."""
    out, now, k = [], "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            now, k = now + pattern[k + 1], k + 2
            continue
        if c in "%_":
            out.append(now)
            now = ""
        else:
            now += c
        k += 1
    return [x for x in [*out, now] if x]


@dataclass
class Index:
    spark: SparkSession
    path: str
    id: str
    text: str

    def build(self, rows: DataFrame, buckets: int, width: int) -> None:
        """Writes the index of ``rows`` (a whole number ``id`` and a ``text``; other columns are kept with the texts): runs in so many buckets, texts in parts of
        ``width`` ids. Null texts are kept and hold nothing; rows need an id."""
        bucket = F.pmod(F.xxhash64("run"), F.lit(buckets)).cast("int")
        found = rows.where(F.col(self.text).isNotNull()).select(F.col(self.id).alias("id"), F.explode(runs(F.col(self.text))).alias("run")).distinct()
        # buckets are hashes of runs, and a frequent run is many rows: these are dealt by their ids too, so no bucket is one task's
        found = found.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "run", "id")
        found.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/runs")
        rows.withColumn("part", F.floor(F.col(self.id) / width).cast("long")).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/texts")
        self.spark.createDataFrame([(buckets, width)], "buckets int, width int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/layout")

    def posting(self, grams: list[str]) -> DataFrame:
        """(id, run) of the texts that hold one of some runs: only these runs' buckets are listed and opened."""
        n = self.spark.read.parquet(f"{self.path}/layout").first().buckets
        known = self.spark.createDataFrame([(g,) for g in grams], "run string").select(F.pmod(F.xxhash64("run"), F.lit(n)).cast("int").alias("b"))
        return self.spark.read.schema("id long, run string, bucket int").parquet(f"{self.path}/runs").where(F.col("bucket").isin([r.b for r in known.collect()]) & F.col("run").isin(grams)).select("id", "run")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts").drop("part")

    def candidates(self, literals: list[str]) -> DataFrame | None:
        """(id) of texts that hold all runs of some literals; None if these have none."""
        grams = sorted({x.lower()[k : k + RUN] for x in literals for k in range(len(x.lower()) - RUN + 1)})
        if not grams:
            return None
        held = self.posting(grams)
        if len(grams) > ASKED:
            counts = {r.run: r["count"] for r in held.groupBy("run").count().collect()}  # one number for each run of the search
            grams = sorted(grams, key=lambda g: counts.get(g, 0))[:ASKED]
            held = self.posting(grams)
        return held.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")

    def parts_of(self, found: DataFrame) -> DataFrame:
        """The texts of the parts that some ids lie in: other parts' files are not opened."""
        width = self.spark.read.parquet(f"{self.path}/layout").first().width
        parts = [r[0] for r in found.select(F.floor(F.col("id") / width)).distinct().limit(PARTS + 1).collect()]
        rows = self.spark.read.parquet(f"{self.path}/texts")
        return (rows.where(F.col("part").isin(parts)) if len(parts) <= PARTS else rows).drop("part")

    def search(self, literals: list[str], test: Column) -> DataFrame:
        """The rows whose text passes ``test``, which must imply that it holds all ``literals`` in any case."""
        found = self.candidates(literals)
        if found is None:
            return self.texts().where(test)
        return self.parts_of(found).join(found.withColumnRenamed("id", self.id), self.id, "left_semi").where(test)

    def contains(self, word: str, ignore_case: bool = True) -> DataFrame:
        """Rows whose text holds ``word``."""
        text = F.lower(F.col(self.text)) if ignore_case else F.col(self.text)
        return self.search([word], F.contains(text, F.lit(word.lower() if ignore_case else word)))

    def like(self, pattern: str, ignore_case: bool = True) -> DataFrame:
        """Rows whose text is like ``pattern``."""
        return self.search(pieces(pattern), F.col(self.text).ilike(pattern) if ignore_case else F.col(self.text).like(pattern))

    def matches(self, pattern: str, literals: list[str]) -> DataFrame:
        """Rows whose text matches a regular expression; ``literals`` are texts that each of its matches holds."""
        return self.search(literals, F.col(self.text).rlike(pattern))

    def lines(self, word: str, ignore_case: bool = False) -> DataFrame:
        """(id, line_no, line) of lines that hold ``word``."""
        low = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
        rows = self.contains(word, ignore_case).select(self.id, F.posexplode(F.split(self.text, "\n")).alias("line_no", "line"))
        return rows.where(F.contains(low(F.col("line")), F.lit(word.lower() if ignore_case else word)))
