"""Date ranges and periods: their texts, as pairs of times on the driver and as columns."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC = dt.timezone.utc
FIRST, LAST = dt.datetime.min.replace(tzinfo=UTC), dt.datetime.max.replace(tzinfo=UTC)
_DAY = dt.timedelta(days=1)


def parse_time(text: str, now: dt.datetime, tz: dt.tzinfo) -> dt.datetime | dt.date:
    """today, yesterday, an ISO date, or an ISO time (of the zone where it names none)."""
    today = dt.datetime.combine(now.astimezone(tz).date(), dt.time(0), tz)
    if text == "today":
        return today
    if text == "yesterday":
        return dt.datetime.combine(today.date() - _DAY, dt.time(0), tz)
    if len(text) <= 10:
        return dt.date.fromisoformat(text)
    at = dt.datetime.fromisoformat(text.split(" ")[0])
    return at if at.tzinfo else at.replace(tzinfo=tz)


def parse_range(text: str, now: dt.datetime, zone: str = "UTC") -> tuple[dt.datetime, dt.datetime]:
    """[start, end) of a date-range text. The second of two dates counts to its last microsecond."""
    tz = ZoneInfo(zone)
    day = lambda d, t=dt.time(0): dt.datetime.combine(d, t, tz)
    if not text:
        return FIRST, LAST
    left, comma, right = text.partition(",")
    a = parse_time(left, now, tz) if left else None
    if not comma:
        if left in ("today", "yesterday"):
            return a, day(a.date() + _DAY)
        return (a, LAST) if isinstance(a, dt.datetime) else (day(a), day(a + _DAY))
    b = parse_time(right, now, tz) if right else None
    if right in ("today", "yesterday"):
        b = day(b.date() + _DAY)
    timed = isinstance(a, dt.datetime) or isinstance(b, dt.datetime)
    start = FIRST if a is None else a if isinstance(a, dt.datetime) else day(a)
    end = LAST if b is None else b if isinstance(b, dt.datetime) else day(b) if timed else day(b, dt.time.max)
    return start, end


def range_columns(text: Column, now: Column) -> tuple[Column, Column]:
    """The same as two columns, in the session's zone; unreadable texts give nulls, open ends the years 1 and 9999."""
    first, last = F.lit("0001-01-01 00:00:00").cast("timestamp"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp")
    one_day, tick = F.expr("INTERVAL 1 DAY"), F.expr("INTERVAL 1 MICROSECOND")
    parts = F.split(text, ",", 2)
    has_two = F.size(parts) == 2
    left, right = parts[0], F.get(parts, F.lit(1))
    today = F.date_trunc("day", now)
    is_day = lambda t: t.rlike(r"^\d{4}-\d\d-\d\d$")
    at = lambda t: F.when(t == "today", today).when(t == "yesterday", today - one_day).otherwise(t.try_cast("timestamp"))
    word = lambda t: t.isin("today", "yesterday")
    start = F.when(left == "", first).otherwise(at(left))
    one = F.when(text == "", last).when(is_day(left) | word(left), at(left) + one_day).otherwise(last)
    timed = ((left != "") & ~is_day(left)) | ((right != "") & ~is_day(right))
    two = F.when(right == "", last).when(word(right), at(right) + one_day).when(is_day(right) & ~timed, at(right) + one_day - tick).otherwise(at(right))
    return start, F.when(has_two, two).otherwise(one)


def period_lists(start: dt.date, end: dt.date) -> tuple[list[int], list[int], list[int]]:
    """(years, months, days of the month) that the days of a period have, for lists of partitions."""
    first, last = dt.date(start.year, start.month, start.day), dt.date(end.year, end.month, end.day)
    some = [first + k * _DAY for k in range(min((last - first).days, 2 * 366) + 1)]  # two years have all months and days
    return list(range(first.year, last.year + 1)), sorted({d.month for d in some}), sorted({d.day for d in some})


def days_between(start: Column, end: Column) -> Column:
    """Each day of a period as an array of dates."""
    return F.sequence(start.cast("date"), end.cast("date"))
