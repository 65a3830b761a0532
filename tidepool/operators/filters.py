"""Filters as Columns, so that Catalyst pushes them to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {"$gte": Column.__ge__, "$gt": Column.__gt__, "$lte": Column.__le__, "$lt": Column.__lt__, "$ne": Column.__ne__, "$eq": Column.__eq__}


def compile_filter(rule: dict) -> Column:
    """A condition from ``{field: value}``, ``{field: {"$gte": value, ...}}``, ``$and`` and ``$or``, nested at will; all keys must hold.
    ``$in`` takes a list. An empty rule holds always, an unknown operator is an error."""
    parts = []
    for key, value in rule.items():
        if key in ("$and", "$or"):
            join = Column.__and__ if key == "$and" else Column.__or__
            parts.append(reduce(join, map(compile_filter, value)) if value else F.lit(key == "$and"))
        elif isinstance(value, dict):
            for op, x in value.items():
                if op == "$in":
                    parts.append(F.col(key).isin(list(x)))
                elif op in _OPS:
                    parts.append(_OPS[op](F.col(key), x))
                else:
                    raise ValueError(f"no operator {op}")
        else:
            parts.append(F.col(key) == value)
    return reduce(Column.__and__, parts, F.lit(True))


def promotion_reason(importance: Column, repetitions: Column, force: Column | None = None) -> Column:
    """Why a memory is kept for long, or why not: by force, its importance, or repetitions with some importance."""
    shown = F.concat(F.lit("importance:"), F.format_string("%.2f", importance))
    reason = F.when(importance >= 0.55, shown).when((repetitions >= 2) & (importance >= 0.35), F.concat(F.lit("repetitions:"), repetitions.cast("string"), F.lit(","), shown)).otherwise(F.concat(F.lit("low_"), shown))
    return reason if force is None else F.when(force, F.lit("forced_promotion")).otherwise(reason)


def long_or_code(text: Column, most: int = 2000, share: float = 0.5, fences: int = 8) -> Column:
    """Longer than ``most``, more than ``share`` of it in fenced blocks, or many fence marks."""
    fenced = F.aggregate(F.regexp_extract_all(text, F.lit("(?s)```.*?```"), F.lit(0)), F.lit(0), lambda s, x: s + F.char_length(x))
    return (F.char_length(text) > most) | (fenced > share * F.char_length(text)) | (F.regexp_count(text, F.lit("```")) >= fences)


def _cron_field(field: str, low: int, high: int) -> list[int]:
    found: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(b) if b else high if step else int(a))
        found |= set(range(first, last + 1, int(step or 1)))
    return sorted(found)


def cron(rule: str, ts: Column) -> Column:
    """Whether a time matches a rule of five fields with lists, ranges and steps; Sunday is 0 or 7."""
    minute, hour, day, month, weekday = rule.split()
    days = {d % 7 for d in _cron_field(weekday, 0, 7)}
    return (
        F.minute(ts).isin(_cron_field(minute, 0, 59)) & F.hour(ts).isin(_cron_field(hour, 0, 23)) & F.dayofmonth(ts).isin(_cron_field(day, 1, 31))
        & F.month(ts).isin(_cron_field(month, 1, 12)) & (F.dayofweek(ts) - 1).isin(sorted(days))
    )
