"""Dates in free text as Columns; today is a parameter. What no rule finds, or no calendar has, is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months; their first three letters stand for them too.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: A month and day, perhaps with its year, in Korean; a day alone, which follows neither a digit nor a month and isn't "n days ago"; an ISO date.
KOREAN_DATE = r"(?:(\d{4})년\s*)?(\d{1,2})월\s*(\d{1,2})일"
KOREAN_DAY = r"(?<![0-9월])(\d{1,2})일(?!\s*전)"
ISO_DATE = r"(\d{4})-(\d{2})-(\d{2})"


def _day(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it; so plans of nested rules stay small."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).cast("int")


def month_day(text: Column, today: Column) -> Column:
    """"march 5th" or "mar 5" in the current year, also if that is to come."""
    names = dict.fromkeys((*MONTHS, *(m[:3] for m in MONTHS)))
    pattern = rf"({'|'.join(names)})\s+(\d{{1,2}})(?:st|nd|rd|th)?"
    low = F.lower(text)
    table = F.create_map(*[x for k, m in enumerate(MONTHS, 1) for x in (F.lit(m[:3]), F.lit(k))])
    return _day(F.year(today), F.try_element_at(table, F.substring(F.regexp_extract(low, pattern, 1), 1, 3)), _int(low, pattern, 2))


def _span(start: Column, end: Column | None = None) -> Column:
    return _once(start, lambda s: F.when(s.isNotNull(), F.struct(s.alias("start"), F.coalesce(end if end is not None else s, s).alias("end"))))


def _before(day: Column, text: Column, pattern: str) -> Column:
    """So many days before as a number in the text says; up to five digits of it count."""
    return F.date_sub(day, F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).cast("int"))


def relative_span(text: Column, today: Column) -> Column:
    """struct(start, end) of today, yesterday, "last week" (seven days up to today) and "n days ago"."""
    low, day = F.lower(text), F.to_date(today)
    week = F.when(low.rlike(r"last\s+week"), F.date_sub(day, 7))
    one = F.when(low.contains("today"), day).when(low.contains("yesterday"), F.date_sub(day, 1))
    return F.coalesce(_span(one), _span(week, day), _span(_before(day, low, r"(\d{1,5})\s+days?\s+ago")))


def relative_day(text: Column, today: Column) -> Column:
    """The first day of ``relative_span``."""
    return relative_span(text, today)["start"]


def _first(text: Column, pattern: str, n: int) -> list[Column]:
    """The n groups of the first match of a pattern as whole numbers; null where there is no match, or the group isn't in it."""
    return [F.when(F.regexp_extract(text, pattern, k) != "", F.regexp_extract(text, pattern, k)).cast("int") for k in range(1, n + 1)]


def iso_day(text: Column) -> Column:
    return _day(*_first(text, ISO_DATE, 3))


def any_day(text: Column, today: Column) -> Column:
    """The first rule that finds a day: a month and day, a relative day, then an ISO date."""
    return F.coalesce(month_day(text, today), relative_day(text, today), iso_day(text))


def korean_day(text: Column, today: Column) -> Column:
    """The first month and day of a text, with its year or this one (a day to come is that of the year before), or else the first day alone (one
    to come is last month's). What other dates the text holds says nothing about the first."""
    now = F.to_date(today)
    year, month, day = _first(text, KOREAN_DATE, 3)
    year = F.coalesce(year, F.year(now))
    date = F.struct(year.alias("y"), month.alias("m"), day.alias("d"))
    named = _once(date, lambda x: F.when(_day(x["y"], x["m"], x["d"]) > now, _day(x["y"] - 1, x["m"], x["d"])).otherwise(_day(x["y"], x["m"], x["d"])))
    last = lambda alone: F.add_months(F.trunc(now, "month"), F.when(alone > F.dayofmonth(now), -1).otherwise(0))
    alone = _once(_first(text, KOREAN_DAY, 1)[0], lambda d: _day(F.year(last(d)), F.month(last(d)), d))
    return F.when(text.rlike(KOREAN_DATE), named).otherwise(alone)


def korean_relative_span(text: Column, today: Column) -> Column:
    """struct(start, end) of today, yesterday, the day before it, last week and the last n days (up to today), and "n days ago"."""
    day = F.to_date(today)
    one = F.when(text.contains("오늘"), day).when(text.contains("어제"), F.date_sub(day, 1)).when(text.rlike("그저[께게]"), F.date_sub(day, 2))
    week = F.when(text.rlike(r"지난\s*주"), F.date_sub(day, 7))
    return F.coalesce(_span(one), _span(week, day), _span(_before(day, text, r"지난\s*([0-9]{1,5})\s*일"), day), _span(_before(day, text, r"([0-9]{1,5})\s*일\s*전")))


def korean_relative(text: Column, today: Column) -> Column:
    """The first day of ``korean_relative_span``."""
    return korean_relative_span(text, today)["start"]


def any_span(text: Column, today: Column) -> Column:
    """struct(start, end) by the first rule that finds a day: Korean dates, Korean relative days, a month and day, relative days, ISO dates."""
    return F.coalesce(
        _span(korean_day(text, today)), korean_relative_span(text, today), _span(month_day(text, today)), relative_span(text, today), _span(iso_day(text))
    )
