"""What each order of a few filters keeps, removes and repeats, by replaying every order on every document.

A document's failures are bits of one number. Each document meets all orders (a broadcast table of n! rows, 120 of five filters), the first
failing step of the order is computed, the steps are exploded, and conditional sums are grouped by part, order and step: partial sums
before the exchange leave a few numbers for each part, order and step of a task, so what is shuffled doesn't grow with a part's documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import written

#: Filters at most: 7! orders are 5,040 rows to broadcast.
FILTERS = 7
#: White space that ends a word, as a pattern of Java.
BLANKS = "[\\x20\\x09-\\x0D]+"


def fails(text: Column) -> dict[str, Column]:
    """The failure conditions of filters A to D on a text without null: few words, repeated words, many capitals, odd characters."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": 100 * different.cast("long") < 50 * n.cast("long"),
        "C": 100 * (F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, A, B, C, D, E, good, toxic) of each row of ``docs``: which filters it fails (E: its text is that of a smaller doc_id)
    and how it is labelled. Null texts and parts are empty.

    A row without doc_id doesn't fail E (it has no smaller ids), nor does another for its sake; rows that share doc_id and text are alike. Of
    several labels of an id, one that says 1 counts; labels without id are not read.

    The first of each text is joined by its id, not by its text, so copies, however many, are spread as ids are.
    """
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = written(whole.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(name) for name, c in fails(F.col("text")).items())))
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    late = F.col("first").isNull() & F.col("doc_id").isNotNull()
    joined = rows.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    no = F.lit(False)
    return joined.select("doc_id", "part", "A", "B", "C", "D", late.alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def audit(flags: DataFrame, filters: str = "ABCDE", part: str = "part", marks: dict[str, str] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <marks>, shapley) for each part, order of ``filters`` (names of
    boolean columns of ``flags``, of one letter each; null is false) and step, zeros included.

    kept: documents that no filter up to this step removes; removed: those that this one removes; redundant: those it would, but an earlier
    one did; unique_fails: those that fail this filter only; each of ``marks`` (result's name: boolean column): removed ones with that mark;
    shapley: removed of this filter, over all orders and steps. Empty tables give no rows; a null part is the empty one.
    """
    if not 0 < len(filters) <= FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"between 1 and {FILTERS} different filters")
    marks, n = {} if marks is None else marks, len(filters)
    bit = {name: 1 << k for k, name in enumerate(filters)}
    orders = ["".join(p) for p in permutations(filters)]
    table = flags.sparkSession.createDataFrame([(k, *(bit[x] for x in o)) for k, o in enumerate(orders)], ", ".join(["o int", *(f"b{k} int" for k in range(n))]))
    failing = sum((F.when(F.col(name), b).otherwise(0) for name, b in bit.items()), F.lit(0))
    rows = flags.select(F.coalesce(F.col(part), F.lit("")).alias("part"), failing.alias("failing"), *(F.coalesce(F.col(c), F.lit(False)).alias(name) for name, c in marks.items()))
    first = F.lit(n + 1)
    for k in reversed(range(n)):
        first = F.when(F.col("failing").bitwiseAND(F.col(f"b{k}")) != 0, k + 1).otherwise(first)
    replayed = rows.crossJoin(F.broadcast(table)).withColumn("first", first)
    steps = replayed.select("part", "o", "failing", "first", *marks, F.posexplode(F.array(*(f"b{k}" for k in range(n)))).alias("step", "bit")).withColumn("step", F.col("step") + 1)
    counted = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0)))
    gone = F.col("first") == F.col("step")
    sums = {
        "kept": counted(F.col("first") > F.col("step")),
        "removed": counted(gone),
        "redundant": counted((F.col("first") < F.col("step")) & (F.col("failing").bitwiseAND(F.col("bit")) != 0)),
        "unique_fails": counted(F.col("failing") == F.col("bit")),
    } | {name: counted(gone & F.col(name)) for name in marks}
    found = steps.groupBy("part", "o", "step").agg(*(c.alias(name) for name, c in sums.items()))
    names = flags.sparkSession.createDataFrame(list(enumerate(orders)), "o int, filter_order string")
    found = found.join(F.broadcast(names), "o").withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    every = Window.partitionBy("part", "filter")  # as many rows as orders
    return found.withColumn("shapley", F.sum("removed").over(every)).select("part", "filter_order", "step", *sums, "shapley")
