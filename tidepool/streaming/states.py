"""Stream operators: the same functions take a batch or a streaming DataFrame where Spark's own operators carry the state, and
ordered folds per key where a rule has a state of its own (the batch form of a stateful stream)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.streaming import stateful


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, started_at, ended_at, events): a session ends after ``gap`` without an event. ``late`` sets a watermark for streams."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.max(ts).alias("ended_at"))
    return out.select(key, F.col("w.start").alias("started_at"), "ended_at", "events")


def repetitions(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n"))


def access_statistics(accesses: DataFrame) -> DataFrame:
    """(memory_id, accesses, channels): channels as a sorted array."""
    used = accesses.select(F.explode("memory_ids").alias("memory_id"), "channel_id")
    return used.groupBy("memory_id").agg(F.count("*").alias("accesses"), F.sort_array(F.collect_set("channel_id")).alias("channels"))


#: Moves that are broadcast; more of them are joined by a shuffle.
MOVES = 10_000


def illegal_moves(states: DataFrame, key: str, order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Rows whose state may not follow the one before; ``allowed`` has (before, after)."""
    rows = states.withColumn("before", F.lag(state).over(Window.partitionBy(key).orderBy(*order))).where("before IS NOT NULL")
    few = allowed.limit(MOVES + 1).count() <= MOVES
    return rows.join(F.broadcast(allowed) if few else allowed, (rows["before"] == allowed["before"]) & (rows[state] == allowed["after"]), "left_anti")


def _fold(events: DataFrame, key: str, step, start, schema: str, columns: list[str]) -> DataFrame:
    """An ordered fold per key over sorted partitions: rows stream through, and only one state is held, so a key of any size fits."""
    rows = events.select(key, *columns).repartition(key).sortWithinPartitions(key, *columns)

    def run(parts):
        now, state = object(), None
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                if row[0] != now:
                    now, state = row[0], start()
                state, found = step(state, row)
                if found is not None:
                    out.append(found)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(run, schema)


#: How many errors of a type within the window alert; of other types the last.
THRESHOLDS, OTHER_THRESHOLD = {"503": 3, "429": 5, "timeout": 5}, 10


def error_alerts(events: DataFrame, key: str = "kind", window: float = 300.0, cooldown: float = 600.0, threshold: int | dict[str, int] | None = None, ts: str | None = None, late: str = "1 minute") -> DataFrame:
    """(kind, s, n): a window begins with the first error and is reset by the first after it expires; reaching the type's threshold in it
    alerts, once in a cooldown. ``events``, a table or a stream (``ts``: its event time, ``late``: how late a row may be), has the key, seconds
    ``s`` and an id for ties; ``threshold`` is one number for all types, or those of some types (others: 10), by default the usual ones. A
    stream's state of a type goes when its window and its cooldown are over."""
    own = THRESHOLDS if threshold is None else threshold
    return stateful.applied(events, key, stateful.ErrorWindow(window, cooldown, lambda k: own if isinstance(own, int) else own.get(k, OTHER_THRESHOLD)), ts, late)


def access_flushes(accesses: DataFrame, key: str, most: int = 50, wait: float = 300.0, idle: float | None = None, ts: str | None = None, late: str = "1 minute") -> DataFrame:
    """(key, id, s, n): which accesses write the ids gathered so far, and how many different ones. They are written when ``most`` wait, or when
    ``wait`` seconds have passed since the last time (at first: since the first access). ``accesses``, a table or a stream, has seconds ``s``, an
    ``id`` for ties and the ``memory_id``; no more than ``most`` ids wait at a time, so the state is bounded. With ``idle``, ids that wait are
    written that long after a key's last access too, with a null id, and a stream's state of the key goes."""
    return stateful.applied(accesses, key, stateful.Flushes(most, wait, idle), ts, late)


def token_bucket(events: DataFrame, key: str, rate: float = 1.0, burst: float = 10.0) -> DataFrame:
    """(key, id, passed): a bucket of ``burst`` tokens fills by ``rate`` a second; an event takes one or is refused."""

    def step(state, row):
        level, last = state
        level = min(burst, level + rate * (row[1] - last)) if last is not None else burst
        passed = level >= 1
        return (level - passed, row[1]), (row[0], row[2], bool(passed))

    return _fold(events, key, step, lambda: (burst, None), f"{key} long, id long, passed boolean", ["s", "id"])


def circuit_breaker(events: DataFrame, key: str, failures: int = 5, wait: float = 30.0, successes: int = 2) -> DataFrame:
    """(key, id, state): closed opens after so many failures in a row; open lets one try after the wait (half-open), which closes after
    so many successes and opens again at a failure. ``events`` has seconds ``s``, ``id`` and ``failed``."""

    def step(state, row):
        mode, n, since = state
        s, failed = row[1], row[3]
        if mode == "open" and s - since >= wait:
            mode, n = "half_open", 0
        if mode == "closed":
            n = n + 1 if failed else 0
            mode, n, since = ("open", 0, s) if n >= failures else (mode, n, since)
        elif mode == "half_open":
            n = 0 if failed else n + 1
            mode, n, since = ("open", 0, s) if failed else ("closed", 0, since) if n >= successes else (mode, n, since)
        return (mode, n, since), (row[0], row[2], mode)

    return _fold(events, key, step, lambda: ("closed", 0, 0.0), f"{key} long, id long, state string", ["s", "id", "failed"])


def cache_hits(events: DataFrame, key: str, ttl: float = 300.0) -> DataFrame:
    """(key, id, hit): an access hits if the entry was put in less than ``ttl`` seconds ago; a miss puts it in."""

    def step(state, row):
        hit = state is not None and row[1] - state < ttl
        return (state if hit else row[1]), (row[0], row[2], bool(hit))

    return _fold(events, key, step, lambda: None, f"{key} long, id long, hit boolean", ["s", "id"])
