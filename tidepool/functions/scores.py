"""Scores as Columns: decay, retrieval, entity importance, vector and text similarity.

Every rule is one expression that Catalyst can push and compile; constants are parameters with the usual values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How fast each type of memory decays.
TYPE_RATES = {"fact": 0.3, "preference": 0.5, "insight": 0.7, "conversation": 1.0}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def hours_between(earlier: Column, later: Column) -> Column:
    """Hours, 0 where a side is null or time would run backwards."""
    seconds = F.unix_micros(later) - F.unix_micros(earlier)
    return F.coalesce(F.greatest(seconds / F.lit(3_600_000_000.0), F.lit(0.0)), F.lit(0.0))


def type_rate(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TYPE_RATES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit(1.0))


def decay(importance: Column, created: Column, last: Column, kind: Column, accesses: Column, connections: Column, channels: Column, now: Column,
          base: float = 0.001, stability: float = 0.3, resistance: float = 0.1, diversity: float = 0.2, floor: float = 0.3, old: float = 168.0, recent: float = 24.0, boost: float = 1.3) -> Column:
    """Importance after exponential decay with age; accesses, connections and channels slow it, old memories that were used lately get a
    boost, and a share of the importance always stays. An age below zero counts as zero; without a creation time the result is 0.5."""
    age = hours_between(created, now)
    rate = base * type_rate(kind) / (1 + diversity * channels) / (1 + stability * F.log1p(accesses.cast("double"))) * (1 - F.least(F.lit(1.0), resistance * connections))
    faded = importance * F.exp(-rate * age)
    faded = F.when((age > old) & (hours_between(last, now) < recent), faded * boost).otherwise(faded)
    return F.when(created.isNull(), F.lit(0.5)).otherwise(F.greatest(faded, floor * importance))


def simple_decay(importance: Column, created: Column, accesses: Column, now: Column, base: float = 0.001, stability: float = 0.3, floor: float = 0.3) -> Column:
    """Decay by time and accesses alone, as retrieval uses it."""
    rate = base / (1 + stability * F.log1p(accesses.cast("double")))
    return F.greatest(importance * F.exp(-rate * hours_between(created, now)), floor * importance)


def retrieval(similarity: Column, importance: Column, decayed: Column) -> Column:
    return similarity * decayed * (0.5 + 0.5 * clamp(importance))


def temporal_boost(score: Column, day: Column, first: str | None, last: str | None) -> Column:
    """An exact day, or a range of days, lifts the score."""
    if first and not last:
        return F.when(day == F.lit(first).cast("date"), score * 0.6 + 0.4).otherwise(score)
    inside = (day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date"))
    return F.when(inside, score * 0.6 + 0.32).otherwise(score)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, tiny: float = 1e-10) -> Column:
    """0 for vectors of different sizes, empty ones, and norms next to nothing."""
    norms = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms[0] >= tiny) & (norms[1] >= tiny)
    return F.when(usable, dot(a, b) / (norms[0] * norms[1])).otherwise(F.lit(0.0))


#: Strings of more bytes are compared without what both begin and end with.
LONG = 256


def byte_distance(a: Column, b: Column) -> Column:
    """Edit distance over UTF-8 bytes. What both strings begin and end with adds nothing to it, and is left out of long ones; what is left is
    searched for small distances first. Only what differs costs time in proportion to both lengths."""

    def between(x: Column, y: Column) -> Column:
        x, y = F.decode(x, "ISO-8859-1"), F.decode(y, "ISO-8859-1")
        return F.coalesce(*[F.nullif(F.levenshtein(x, y, most), F.lit(-1)) for most in (16, 128, 1024)], F.levenshtein(x, y))

    def alike(x: Column, y: Column, end: bool) -> Column:
        """How many bytes both begin (or end) with: doubled steps, since what is alike over a length is so over all smaller ones."""
        cut = lambda s, n: F.substring(s, F.octet_length(s) - n + 1, n) if end else F.substring(s, F.lit(1), n)
        fits = lambda n: (n <= F.least(F.octet_length(x), F.octet_length(y))) & (cut(x, n) == cut(y, n))
        return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), lambda n, step: F.when(fits(n + step), n + step).otherwise(n))

    pair = F.array(F.struct(a.cast("binary").alias("x"), b.cast("binary").alias("y")))  # an array of one, so that each step is made once
    for end in (True, False):
        pair = F.transform(pair, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), alike(p["x"], p["y"], end).alias("n")))  # noqa: B023
        left = lambda p, s: F.substring(p[s], F.lit(1) if end else p["n"] + 1, F.octet_length(p[s]) - p["n"]).alias(s)  # noqa: B023, E731
        pair = F.transform(pair, lambda p: F.struct(left(p, "x"), left(p, "y")))  # noqa: B023
    rest = F.transform(pair, lambda p: between(p["x"], p["y"]))[0]
    return F.when(F.greatest(F.octet_length(a), F.octet_length(b)) > LONG, rest).otherwise(between(F.encode(a, "UTF-8"), F.encode(b, "UTF-8")))


def string_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - byte_distance(a, b) / longest)


def entity_importance(mentions: Column, degree: Column, recency: Column, person: Column) -> Column:
    score = 0.5 * F.least(F.lit(1.0), mentions / 100.0) + 0.3 * F.least(F.lit(1.0), degree / 20.0) + 0.2 * recency
    return F.when(person, F.least(F.lit(1.0), score * 1.2)).otherwise(score)


def tokens(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("long")


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))


def engagement(duration: Column, tools: Column, latency: Column) -> Column:
    """Mean of three shares: session seconds up to half an hour, tool use up to five, and latency from five seconds down to half a second."""
    return (F.least(F.lit(1.0), duration / 1800.0) + F.least(F.lit(1.0), tools / 5.0) + clamp((5000.0 - latency) / 4500.0)) / 3


def dynamic_rate(active_hours: Column, base: float = 0.002, low: float = 0.0005, high: float = 0.002) -> Column:
    """The base rate of decay, between bounds, for how many hours of a day somebody is active."""
    return clamp(base * (0.8 + 0.4 * F.least(F.lit(1.0), active_hours / 16.0)), low, high)
