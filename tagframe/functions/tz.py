"""Short names of time zones (`New_York`) and full ones (`America/New_York`)."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The regions whose zones have short names, first come first served.
REGIONS = ("Africa", "America", "Antarctica", "Asia", "Atlantic", "Australia", "Etc", "Europe", "Indian", "Pacific")


def zones() -> dict[str, str]:
    """Short name -> full name, from the zone data of the system."""
    out = {"UTC": "UTC", "GMT": "Etc/GMT"}
    for name in sorted((z for z in available_timezones() if z.split("/")[0] in REGIONS), key=lambda z: (REGIONS.index(z.split("/")[0]), z)):
        out.setdefault(name.rsplit("/", 1)[-1], name)
    return out


def zone_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(zones().items()), "tz_short string, tz_full string")


def with_full_zone(df: DataFrame, short: str, out: str = "tz_full") -> DataFrame:
    """Adds full names; a name that is full already stays, an unknown one gives null."""
    t = zone_table(df.sparkSession)
    known = F.broadcast(t.unionByName(t.select(F.col("tz_full").alias("tz_short"), "tz_full")).dropDuplicates(["tz_short"]).select(F.col("tz_short").alias(short), F.col("tz_full").alias(out)))
    return df.drop(out).join(known, short, "left")


def with_short_zone(df: DataFrame, full: str, out: str = "tz_short") -> DataFrame:
    known = F.broadcast(zone_table(df.sparkSession).select(F.col("tz_full").alias(full), F.col("tz_short").alias(out)).dropDuplicates([full]))
    return df.drop(out).join(known, full, "left")


@lru_cache(1)
def offset_intervals() -> list[tuple[int, int, int, str]]:
    """(offset in seconds, from, until, short name): for each offset, when which zone is the first to have it.

    Instants are seconds, from 1970 to 2038. The rows are bounded by the zone data; times of change are found by halving.
    """
    begin, end, step = 0, 2**31, 20 * 86_400
    at = lambda zone, t: int(dt.datetime.fromtimestamp(t, zone).utcoffset().total_seconds())
    held: dict[int, list[tuple[int, int, str]]] = {}
    for short, full in zones().items():
        zone, start = ZoneInfo(full), begin
        offset, last = at(zone, begin), begin
        for t in [*range(begin + step, end, step), end]:
            now = at(zone, t)
            if now != offset:
                low, high = last, t
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if at(zone, middle) == offset else (low, middle)
                held.setdefault(offset, []).append((start, high, short))
                start, offset = high, now
            last = t
        held.setdefault(offset, []).append((start, end, short))
    out = []
    for offset, spans in held.items():
        free = [(begin, end)]  # what no earlier zone has taken
        for start, until, short in spans:
            left = []
            for a, b in free:
                x, y = max(a, start), min(b, until)
                if x < y:
                    out.append((offset, x, y, short))
                    left += [(a, x), (y, b)]
                else:
                    left.append((a, b))
            free = [(a, b) for a, b in left if a < b]
    return out


def with_zone_of_offset(df: DataFrame, ts: str, offset: str, out: str = "tz_short") -> DataFrame:
    """Adds the short name of a zone whose offset (in seconds) at an instant is the given one: UTC for 0, else the first; null if none."""
    known = df.sparkSession.createDataFrame([r for r in offset_intervals() if r[0]] + [(0, 0, 2**62, "UTC"), (0, -(2**62), 0, "UTC")], f"_offset int, _from bigint, _until bigint, {out} string")
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    return df.drop(out).join(F.broadcast(known), (F.col(offset) == F.col("_offset")) & (at >= F.col("_from")) & (at < F.col("_until")), "left").drop("_offset", "_from", "_until")


def local_time(ts: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(ts, zone)


def utc_time(ts: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(ts, zone)
