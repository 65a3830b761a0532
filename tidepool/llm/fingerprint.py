"""Homomorphic multiset fingerprints of documents, with Spark expressions only.

A paragraph is a non-empty run between newlines. Each paragraph has a wide vector
of numbers taken from SHA-256 digests, and a text's fingerprint is the sum of its
paragraphs' vectors, every number modulo a power of two. So the order of
paragraphs doesn't matter, and a paragraph is put in or taken out by adding or
subtracting its vector (``combine`` and ``remove``). The vector has

* 1, modulo 2**32: the number of paragraphs;
* four numbers of 60 bits of the paragraph's digest, modulo 2**60: these decide equality;
* the number of its sentences, modulo 2**32, and 120 counts, packed by two into
  60 numbers modulo 2**60: how many of its sentences have each of 120 bits of
  their digests set. With the number of sentences, such a count is a sum of signs,
  whose squares estimate the size of a multiset and of the difference of two:
  the likeness. (Counts are exact below 2**30, more sentences than a row can have.)

A null text is empty; empty texts have the sum of nothing, all zeros, and equal
texts always have a likeness of 1. Digests are compared as text: 8 + 4 x 15 + 8 +
30 x 15 hexadecimal digits, the counts added up by four, 15 bits apart, modulo 2**60.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M32, M60 = (1 << 32) - 1, (1 << 60) - 1
#: The lowest bit of each of four counts in one number of a digest, and of each of two in one of a vector.
LOW = sum(1 << (15 * j) for j in range(4))
LOW_2, M30 = 1 | 1 << 30, (1 << 30) - 1
PARAGRAPHS, SENTENCES = r"\n+", r"[.!?]+[ \t]+|\n+"
#: Documents that lie in one range of ids while each finds the next, about, and ranges at most.
RANGE, RANGES = 256, 16_384


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def _number(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("long")


def _sum(numbers: Column, value=lambda x: x) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: (a + value(x)).bitwiseAND(F.lit(M60)))


def _fresh(df: DataFrame, name: str) -> str:
    """A column's name that ``df`` doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def with_vector(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds column ``to``: struct(paragraphs, wide, sentences, signs) of the column ``text`` (not null); other columns, whatever their names, stay.

    Of texts of fewer than 2**15 sentences four counts are added up in one number, 15 bits apart, and then set 30 bits apart as those of longer ones."""
    numbers = lambda n: lambda x: F.transform(F.array(F.sha2(x, 256)), lambda d: F.array(*[_number(d, k) for k in range(n)]))[0]
    p, s, q = (_fresh(df, x) for x in ("_p", "_s", "_q"))
    kept = df.columns
    df = df.withColumn(p, F.transform(_parts(F.col(text), PARAGRAPHS), numbers(4)))
    df = df.withColumn(s, F.transform(_parts(F.col(text), SENTENCES), numbers(2)))
    added = lambda k, shift, low: F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.shiftright(x[k], shift).bitwiseAND(F.lit(low)))
    df = df.withColumn(q, F.when(F.size(s) < 1 << 15, F.array(*[added(k, shift, LOW) for k in range(2) for shift in range(15)])))
    lane = lambda k, shift, j: F.shiftright(F.col(q)[15 * k + shift], 15 * j).bitwiseAND(F.lit((1 << 15) - 1))
    few = F.array(*[lane(k, shift % 15, shift // 15) + F.shiftleft(lane(k, shift % 15, shift // 15 + 2), 30) for k in range(2) for shift in range(30)])
    many = F.array(*[added(k, shift, LOW_2) for k in range(2) for shift in range(30)])
    wide = F.array(*[_sum(F.col(p), lambda x, k=k: x[k]) for k in range(4)])
    signs = F.when(F.col(q).isNotNull(), few).otherwise(many)
    vector = F.struct(F.size(p).cast("long").alias("paragraphs"), wide.alias("wide"), F.size(s).cast("long").alias("sentences"), signs.alias("signs"))
    return df.withColumn(to, vector).select(*kept, to)


def _merge(a: Column, b: Column, sign: int) -> Column:
    add = lambda m: lambda x, y: (x + sign * y).bitwiseAND(F.lit(m))
    return F.struct(
        add(M32)(a["paragraphs"], b["paragraphs"]).alias("paragraphs"),
        F.zip_with(a["wide"], b["wide"], add(M60)).alias("wide"),
        add(M32)(a["sentences"], b["sentences"]).alias("sentences"),
        F.zip_with(a["signs"], b["signs"], add(M60)).alias("signs"),
    )


def combine(a: Column, b: Column) -> Column:
    """The vector of two texts' paragraphs together."""
    return _merge(a, b, 1)


def remove(a: Column, b: Column) -> Column:
    """The vector of ``a`` without the paragraphs of ``b``."""
    return _merge(a, b, -1)


def digest(v: Column) -> Column:
    """The fingerprint as text."""
    hexed = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    long = lambda xs: F.array_join(F.transform(xs, lambda x: hexed(x, 15)), "")
    signs = F.array(*[(v["signs"][30 * k + s] + F.shiftleft(v["signs"][30 * k + s + 15].bitwiseAND(F.lit(M60 >> 15)), 15)).bitwiseAND(F.lit(M60)) for k in range(2) for s in range(15)])
    return F.concat(hexed(v["paragraphs"].bitwiseAND(F.lit(M32)), 8), long(v["wide"]), hexed(v["sentences"].bitwiseAND(F.lit(M32)), 8), long(signs))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: an estimate of 2 a.b / (a.a + b.b) of the multisets of sentences; 1 for equal vectors, texts without sentences included."""
    lanes = lambda v: F.flatten(F.transform(v["signs"], lambda x: F.array(*[(2 * F.shiftright(x, 30 * j).bitwiseAND(F.lit(M30)) - v["sentences"]).cast("double") for j in range(2)])))
    square = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x * x)
    apart, both = square(F.zip_with(lanes(a), lanes(b), lambda x, y: x - y)), square(lanes(a)) + square(lanes(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - apart / both))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every document."""
    rows = with_vector(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), "text", "v")
    return rows.select("doc_id", digest(F.col("v")).alias("fingerprint"))


def _range_of(id: Column, ends: list[int]) -> Column:
    """How many of the sorted ``ends`` are less than an id, -1 for a null id: looked for among every so many first, then between two of these."""
    step = max(1, math.isqrt(len(ends)))
    groups = [ends[k : k + step] for k in range(0, len(ends), step)]
    tops = F.from_json(F.lit(str([g[-1] for g in groups])), "array<bigint>")
    some = F.try_element_at(F.from_json(F.lit(str(groups)), "array<array<bigint>>"), F.size(F.filter(tops, lambda e: e < id)) + 1)
    place = F.size(F.filter(tops, lambda e: e < id)) * step + F.coalesce(F.size(F.filter(some, lambda e: e < id)), F.lit(0))
    return F.when(id.isNull(), -1).otherwise(place).cast("int")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text, whose second half is replaced by the beginning of the next document.

    Next is by descending doc_id, then text (null ids last); after the last comes the first. Documents are dealt by ranges of ids that
    end at quantiles, so about as many lie in each however ids are spread, and one shuffle of the texts serves the search for the next; only
    the first document of each range is read again, for the last of the range above it. Repeated rows are documents of their own, but those
    of one id lie in one range, as do those without an id.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, nulls = rows.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    count = min(RANGES, -(-n // RANGE))
    # each quantile is an id, that of the first document of its range; the last is the largest
    ends = sorted(set(rows.agg(F.percentile_approx("doc_id", [(k + 1) / count for k in range(count)], 10 * count)).first()[0])) if count else []
    rows = rows.withColumn("range", _range_of(F.col("doc_id"), ends))

    at = rows.sparkSession.createDataFrame(list(enumerate(ends)), "range int, doc_id long")  # a number of each range
    heads = rows.drop("range").join(F.broadcast(at), "doc_id").groupBy("range").agg(F.max("text").alias("text"))
    if nulls:
        heads = heads.unionByName(rows.where("doc_id IS NULL").agg(F.max("text").alias("text")).select(F.lit(-1).alias("range"), "text"))
    every = [-1] * (nulls > 0) + list(range(len(ends)))
    below = rows.sparkSession.createDataFrame([(x, every[k - 1]) for k, x in enumerate(every)], "at int, range int")
    after = with_vector(heads.join(F.broadcast(below), "range").select(F.col("at").alias("range"), F.col("text").alias("head")), "head", "head_v")

    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    own = with_vector(rows.repartition("range"), "text", "v")
    own = own.select("range", "doc_id", "text", "v", F.lead("text").over(order).alias("next"), F.lead("v").over(order).alias("next_v"))
    both = own.join(after, "range", "left").select(
        "doc_id", "text", "v", F.coalesce("next", "head").alias("next"), F.coalesce("next_v", "head_v").alias("next_v"), F.char_length("text").alias("n")
    )
    cut = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - cut), F.substring(F.col("next"), F.lit(1), cut))
    both = with_vector(both.select("doc_id", "v", "next_v", F.col("n").cast("long").alias("n_chars"), edited.alias("edited")), "edited", "edited_v")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("v")).alias("fingerprint"),
        digest(F.col("edited_v")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("edited_v")).alias("near_edited"),
        likeness(F.col("v"), F.col("next_v")).alias("near_next"),
    )
