"""Ordered rules with a state of their own, the same for tables and streams.

A rule is a step over the sorted rows of one key, as arrays: it takes a state and gives what it found and the next state. ``over_table`` folds
sorted partitions: a key's rows stream through in Arrow batches, and one small state is held. ``over_stream`` keeps the state of each key in
the state store of a stream, which a restart from the checkpoint goes on with, and sets timers by event time: when the watermark has passed
what the state says, the key is settled (it may find something more) and its state is removed. Rows with a null in what a rule reads are left out.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule(ABC):
    """``columns`` are read and sorted by, seconds first; ``found`` are the columns that it finds (without the key); ``state`` is the state's schema."""

    columns: tuple[str, ...]
    found: str
    state: str

    @abstractmethod
    def start(self) -> tuple: ...

    @abstractmethod
    def step(self, key, rows: list[np.ndarray], state: tuple) -> tuple[list[tuple], tuple]:
        """(found rows, next state) of some rows of a key, in order."""

    def due(self, key, state: tuple) -> float | None:
        """When the state says nothing more about rows that are still to come, in seconds; never if None."""
        return None

    def settle(self, key, state: tuple) -> list[tuple]:
        """What is found when that time has come."""
        return []


def _first_at(s: np.ndarray, since: float, gap: float, strict: bool) -> int:
    """The first place whose distance from ``since`` is ``gap`` or more (strictly more): searched by the sum, settled by the difference."""
    at = int(np.searchsorted(s, since + gap))
    beyond = (lambda x: x - since > gap) if strict else (lambda x: x - since >= gap)
    while at > 0 and beyond(s[at - 1]):
        at -= 1
    while at < len(s) and not beyond(s[at]):
        at += 1
    return at


class ErrorWindow(Rule):
    """(s, n): a window begins with the first error and is reset by the first after it expires; n errors in it, as many as the threshold of the key or
    more, alert, once in a cooldown."""

    columns, found, state = ("s", "id"), "s double, n long", "begin double, n long, alerted double"

    def __init__(self, window: float, cooldown: float, threshold: Callable[[object], int]):
        self.window, self.cooldown, self.threshold = window, cooldown, threshold

    def start(self):
        return None, 0, None

    def step(self, key, rows, state):
        (begin, n, alerted), s, least, found, i = state, rows[0], self.threshold(key), [], 0
        while i < len(s):
            if begin is None or s[i] - begin > self.window:
                begin, n = float(s[i]), 0
            end = max(i + 1, _first_at(s, begin, self.window, True))
            j = i + max(0, least - n - 1)
            while j < end:
                if alerted is not None and s[j] - alerted < self.cooldown:
                    j = max(j + 1, _first_at(s, alerted, self.cooldown, False))
                    continue
                alerted = float(s[j])
                found.append((alerted, n + j - i + 1))
                j += 1
            n, i = n + end - i, end
        return found, (begin, n, alerted)

    def due(self, key, state):
        begin, _, alerted = state
        return None if begin is None else max(begin + self.window, -np.inf if alerted is None else alerted + self.cooldown)


class Flushes(Rule):
    """(id, s, n): ids gather and are written, n different ones, when ``most`` wait or ``wait`` seconds have passed since the last time (at first:
    since the first access), by the access of this id and time. With ``idle``, what waits is also written that many seconds after a key's last
    access, by no access (id is null), and the key begins anew."""

    columns, found, state = ("s", "id", "memory_id"), "id long, s double, n long", "last double, seen double, waiting array<long>"

    def __init__(self, most: int, wait: float, idle: float | None):
        self.most, self.wait, self.idle = most, wait, idle

    def start(self):
        return None, None, ()

    def step(self, key, rows, state):
        (last, seen, waiting), (s, ids, memory), found, i = state, rows, [], 0
        waiting = set(waiting)
        while i < len(s):
            if self.idle is not None and seen is not None and s[i] - seen > self.idle:
                found += self.settle(key, (last, seen, waiting))
                last, seen, waiting = self.start()[0], None, set()
            last = float(s[i]) if last is None else last
            # up to the first access that writes by time, or that ends a run without pauses
            end = min(len(s), max(i, _first_at(s, last, self.wait, False)) + 1)
            if self.idle is not None:
                pause = np.flatnonzero(np.diff(s[i:end]) > self.idle)
                end = i + int(pause[0]) + 1 if len(pause) else end
            stop, size = None, 4 * self.most
            while stop is None:  # in growing parts: few of a part's rows may be new ids
                part = memory[i : min(end, i + size)]
                new, at = np.unique(part, return_index=True)
                at = np.sort(at[~np.isin(new, list(waiting))]) if waiting else np.sort(at)
                if len(waiting) + len(at) >= self.most:
                    stop = i + int(at[self.most - len(waiting) - 1]) if self.most > len(waiting) else i
                elif i + size >= end:
                    stop = end - 1
                size *= 4
            waiting.update(memory[i : stop + 1].tolist())
            seen = float(s[stop])
            if len(waiting) >= self.most or s[stop] - last >= self.wait:
                found.append((int(ids[stop]), seen, len(waiting)))
                last, waiting = seen, set()
            i = stop + 1
        return found, (last, seen, tuple(sorted(waiting)))

    def due(self, key, state):
        return None if self.idle is None or state[1] is None else state[1] + self.idle

    def settle(self, key, state):
        return [(None, state[1] + self.idle, len(state[2]))] if self.idle is not None and len(state[2]) else []


def _schema(events: DataFrame, key: str, rule: Rule) -> str:
    return f"{key} {dict(events.dtypes)[key]}, {rule.found}"


def over_table(events: DataFrame, key: str, rule: Rule) -> DataFrame:
    """What a rule finds in a table; a key of any size is one task's, as its order demands, and is never held."""
    rows = events.select(key, *rule.columns).dropna(subset=list(rule.columns))
    rows = rows.repartition(key).sortWithinPartitions(key, *rule.columns)
    names = [c.split()[0] for c in rule.found.split(", ")]
    schema = _schema(events, key, rule)

    def run(batches):
        now, state, begun, kind = None, None, False, None

        def shown(rows):
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) + 1)
            types = [kind, *({"double": pa.float64(), "long": pa.int64()}[c.split()[1]] for c in rule.found.split(", "))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], [key, *names])

        for batch in batches:
            kind, keys, out = batch.column(0).type, batch.column(0).to_pylist(), []
            columns = [batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(rule.columns))]
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if not begun or keys[a] != now:
                    out += [(now, *r) for r in rule.settle(now, state)] if begun else []
                    now, state, begun = keys[a], rule.start(), True
                found, state = rule.step(now, [c[a:b] for c in columns], state)
                out += [(now, *r) for r in found]
            yield shown(out)
        if begun:
            yield shown([(now, *r) for r in rule.settle(now, state)])

    return rows.mapInArrow(run, schema)


class _Keyed(StatefulProcessor):
    def __init__(self, rule: Rule, key: str):
        self.rule, self.key = rule, key
        self.names = [key, *(c.split()[0] for c in rule.found.split(", "))]

    def init(self, handle) -> None:
        self.handle, self.store = handle, handle.getValueState("state", self.rule.state)

    def _shown(self, key, found) -> pd.DataFrame:
        return pd.DataFrame([(key, *r) for r in found], columns=self.names).astype({n: "Int64" for n, c in zip(self.names[1:], self.rule.found.split(", "), strict=True) if c.endswith(" long")})

    def handleInputRows(self, key, rows, timerValues):
        own = pd.concat(list(rows), ignore_index=True).sort_values(list(self.rule.columns))
        state = self.store.get()
        state = self.rule.start() if state is None else tuple(list(x) if hasattr(x, "__len__") else x for x in state)
        found, state = self.rule.step(key[0], [own[c].to_numpy() for c in self.rule.columns], state)
        self.store.update(tuple(list(x) if isinstance(x, tuple) else x for x in state))
        due = self.rule.due(key[0], state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(int(due * 1000) + 1)
        if found:
            yield self._shown(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.store.get()
        found = [] if state is None else self.rule.settle(key[0], tuple(state))
        self.store.clear()
        if found:
            yield self._shown(key[0], found)

    def close(self) -> None:
        pass


def over_stream(events: DataFrame, key: str, rule: Rule, ts: str, late: str) -> DataFrame:
    """What a rule finds in a stream, whose rows may come ``late`` by the event time ``ts``. Rows of a key are ordered inside a micro-batch, whose
    rows of one key are held together (limit them at the source); between micro-batches the order of arrival counts. The session's state store
    has to be RocksDB's."""
    if events.sparkSession.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS}")
    rows = events.dropna(subset=list(rule.columns)).withWatermark(ts, late).select(key, *rule.columns, ts)
    return rows.groupBy(key).transformWithStateInPandas(_Keyed(rule, key), _schema(events, key, rule), "Append", "EventTime")


def applied(events: DataFrame, key: str, rule: Rule, ts: str | None = None, late: str = "1 minute") -> DataFrame:
    """A rule over a table or a stream, whichever ``events`` is; a stream needs the column of event times."""
    if not events.isStreaming:
        return over_table(events, key, rule)
    if ts is None:
        raise ValueError("a stream needs the column of event times")
    return over_stream(events, key, rule, ts, late)
