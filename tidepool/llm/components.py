"""Connected components of a link table, by alternating large and small stars.

Each round joins every node's links with the least node among its neighbours (a
grouped minimum, combined before the shuffle). Links are dealt by node and salt, so
a hub's lie in many tasks; labels and links stay distributed. Rounds are written to the shared
checkpoint folder, and only two numbers of each come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut_lineage


#: Parts of a hub's links.
SALTS = 64


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Links (u, v) of each row's pairs of columns, in one pass: a union would plan and run all before it once for each pair."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs))))


def _least(edges: DataFrame) -> DataFrame:
    """Adds to links (u, v) the least of u and its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def _least_of_hubs(edges: DataFrame) -> DataFrame:
    """The same; the minimum of a node goes to each of its salts, so no task has all links of a hub."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts")).select("u", F.explode("salts").alias("salt"), "m")
    return salted.join(least, ["u", "salt"]).select("u", "v", F.least("u", "m").alias("m"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of a link with the least node of its component. Links of a node to itself or to null count for nothing."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    before = None
    while True:
        both = _each(edges, ("u", "v"), ("v", "u"))
        large = _least_of_hubs(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _least(down)  # links go down to the least node here, which has its hub's links from the other side
        edges = _each(small, ("v", "m"), ("u", "m")).where("u <> v").distinct()
        edges = cut_lineage(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
