"""Order-dependent selections as windows, and greedy ones as a fold per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.graph import cut as _cut


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return newest(df, keys, order, 1)


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def within_budget(df: DataFrame, keys: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows of each group up to the first that goes over the budget, with the running ``total``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(size).over(w)).where(F.col("total") <= budget)


def with_context(lines: DataFrame, doc: str, n: str, line: str) -> DataFrame:
    """Lines with those before and after."""
    w = Window.partitionBy(doc).orderBy(n)
    return lines.withColumn("before", F.lag(line).over(w)).withColumn("after", F.lead(line).over(w))


def greedy_budget(df: DataFrame, keys: list[str], id: str, score: str, size: str, topic: str, budget: int, per_topic: int = 2) -> DataFrame:
    """Rows taken in order of score while they fit: one that doesn't fit, or whose topic has enough, is skipped, not the end.

    (keys, id, place) of what is taken. One fold over the sorted rows of each group, so a group must fit into one row; groups here
    are the candidates of one query, which a limit bounds.
    """
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(id).alias("id"), F.col(size).cast("long").alias("n"), F.col(topic).alias("topic")))).alias("rows"))
    kind = f"array<struct<id:{dict(df.dtypes)[id]},topic:{dict(df.dtypes)[topic]}>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("taken"))

    def step(acc, x):
        same = F.size(F.filter(acc["taken"], lambda t: t["topic"].eqNullSafe(x["topic"])))
        fits = (acc["used"] + x["n"] <= budget) & (same < per_topic)
        return F.when(fits, F.struct((acc["used"] + x["n"]).alias("used"), F.array_append(acc["taken"], F.struct(x["id"].alias("id"), x["topic"].alias("topic"))).alias("taken"))).otherwise(acc)

    taken = rows.select(*keys, F.posexplode(F.aggregate("rows", start, step)["taken"]).alias("place", "t"))
    return taken.select(*keys, F.col("t.id").alias(id), "place")


def moving_average(df: DataFrame, key: str, ts: str, id: str, value: str, alpha: float) -> DataFrame:
    """(key, average): the exponential average of a key's values, each weighed by 1 - (1 - alpha) ** (hours since the last / 6); the first
    counts whole. Later values fade a value by powers that add up to the time from it to the last, so one sum takes the fold's place."""
    w = Window.partitionBy(key).orderBy(ts, id)
    s = F.unix_micros(ts) / 1e6
    rows = df.select(key, value, s.alias("s"), (s - F.lag(s).over(w)).alias("gap"), F.max(s).over(Window.partitionBy(key)).alias("last"))
    kept = lambda seconds: F.pow(F.lit(1 - alpha), seconds / 21_600)
    weight = F.when(F.col("gap").isNull(), F.lit(1.0)).otherwise(1 - kept(F.col("gap"))) * kept(F.col("last") - F.col("s"))
    return rows.groupBy(key).agg(F.sum(F.col(value) * weight).alias("average"))


def placed(df: DataFrame, order: list[Column], to: str = "place") -> DataFrame:
    """``df`` with the place of each row (from 1) in an order over all of it: ranges of the order are ranked for themselves, and the sizes of
    those before are added, so no task has all rows. One number of each range comes to the driver."""
    ranged = _cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    before, total = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("_part").count().collect())):
        before += [F.lit(part), F.lit(total)]
        total += n
    start = F.element_at(F.create_map(*before), F.col("_part")) if before else F.lit(0)
    return ranged.select(*df.columns, (F.col("_at") + start + 1).cast("long").alias(to))
