"""Versions of entity tables as intervals (customer_id, id, start_datetime, end_datetime, ...).

Intervals are closed; one ends a microsecond before the next begins, and the open one ends at END. Every shuffle keys on
(customer_id, id), never on the tenant alone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kinds
from ..operators.diff import GONE, tags_patched
from ..operators.grid import tag_hash

END = "9999-12-31 23:59:59"


def tick() -> Column:
    return F.expr("INTERVAL 1 MICROSECOND")


KEYS = ("customer_id", "id")
#: Rows up to which a table of snapshot times is copied to every task.
TIMES = 100_000


def normal_version(version: dt.datetime | dt.date) -> dt.datetime:
    """A date, or exact midnight, means the end of that day."""
    if not isinstance(version, dt.datetime):
        return dt.datetime.combine(version, dt.time(23, 59, 59))
    return version.replace(hour=23, minute=59, second=59) if version.time() == dt.time(0) else version


def normal_version_column(version: Column) -> Column:
    """The same for a column of timestamps."""
    day = F.date_trunc("day", version)
    return F.when(version == day, day + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")).otherwise(version)


def closed(starts: DataFrame, keys: tuple[str, ...] = KEYS, start: str = "start_datetime", end: str = "end_datetime") -> DataFrame:
    """Adds the end of each version: a tick before the next start of the same key."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return starts.withColumn(end, F.coalesce(following - tick(), F.lit(END).cast("timestamp")))


def as_of(versions: DataFrame, when: dt.datetime | dt.date | str, tenant: str | None = None) -> DataFrame:
    """The rows in force at a time."""
    at = F.lit(when if isinstance(when, str) else normal_version(when)).cast("timestamp")
    out = versions.where((F.col("start_datetime") <= at) & (at <= F.col("end_datetime")))
    return out if tenant is None else out.where(F.col("customer_id") == tenant)


def version_dates(versions: DataFrame, tenant: str | None = None) -> DataFrame:
    """Start times of all versions, in order."""
    rows = versions if tenant is None else versions.where(F.col("customer_id") == tenant)
    return rows.select("start_datetime").distinct().orderBy("start_datetime")


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join in which nulls of a key meet, too."""
    other = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    held = F.lit(True)
    for c in on:
        held = held & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(other, held).drop(*[f"_on_{c}" for c in on])


def history(snapshots: DataFrame, state: Column, keys: tuple[str, ...] = KEYS, taken: str = "taken", scope: tuple[str, ...] = ("customer_id",), times: DataFrame | None = None) -> DataFrame:
    """Intervals from full snapshots: a key gets a new one only where its state changed, and ends where it is missing.

    snapshots has one row per key and time `taken`; state is what a change is judged by (a hash, or a struct). scope: the
    columns that say which snapshots belong together. times: scope and `taken` of all snapshots, empty ones too (by
    default those of the rows). They are counted, and where they are few, copied to the tasks, as the rows of a snapshot
    would all meet in one; more of them are joined by shuffle.
    """
    times = (snapshots if times is None else times).select(*scope, taken).distinct()
    next_time = times.withColumn("_next", F.lead(taken).over(Window.partitionBy(*scope).orderBy(taken)))
    if times.limit(TIMES + 1).count() <= TIMES:
        next_time = F.broadcast(next_time)
    own = Window.partitionBy(*keys).orderBy(taken)
    rows = snapshots.withColumn("_state", state)
    rows = _met(rows, next_time, [*scope, taken])
    before = F.lag(F.struct("_state", "_next")).over(own)
    rows = rows.withColumn("_before", before)
    fresh = F.col("_before").isNull() | (F.col("_before._next") != F.col(taken)) | ~F.col("_before._state").eqNullSafe(F.col("_state"))
    rows = rows.withColumn("_run", F.sum(fresh.cast("int")).over(own))
    others = [c for c in snapshots.columns if c not in (*keys, taken)]
    held = F.struct(F.lit(True).alias("_there"), *[F.col(f"`{c}`") for c in others])
    runs = rows.groupBy(*keys, "_run").agg(F.min_by(held, taken).alias("_row"), F.min(taken).alias("start_datetime"), F.max_by("_next", taken).alias("_gone"))
    out = runs.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in others], "start_datetime", "_gone")
    return out.withColumn("end_datetime", F.coalesce(F.col("_gone") - tick(), F.lit(END).cast("timestamp"))).drop("_gone")


def tag_history(snapshots: DataFrame) -> DataFrame:
    """The same for tag-map snapshots (customer_id, id, taken, tags)."""
    return history(snapshots, tag_hash(F.col("tags")))


def changed(versions: DataFrame, patch: DataFrame, now: dt.datetime | str, gone: Column | None = None) -> DataFrame:
    """Applies a patch at a time: the open version of each changed key ends a tick before, and new ones begin.

    versions: keys, start_datetime, end_datetime and value columns; patch: keys and value columns. Rows of the patch for
    which `gone` holds, or whose tags have `remove_`, only close. Columns of the patch replace those of the open version
    where they are not null; tag maps are patched tag by tag, and tags whose new value is REMOVE go. Only open versions
    are joined; closed ones pass as they are.
    """
    at, last = F.lit(now).cast("timestamp"), F.lit(END).cast("timestamp")
    values = [c for c in versions.columns if c not in (*KEYS, "start_datetime", "end_datetime")]
    empty = F.create_map().cast(kinds.TAGS)
    tagged = [v for v in values if versions.schema[v].dataType == kinds.TAGS and v in patch.columns]
    leaves = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    for v in tagged:
        leaves = leaves | F.coalesce(F.map_contains_key(v, F.lit(GONE)), F.lit(False))
    p = patch.select(*KEYS, leaves.alias("_gone"), F.struct(*[(F.col(v) if v in patch.columns else F.lit(None)).cast(versions.schema[v].dataType).alias(v) for v in values]).alias("_p"))

    def merged(v: str) -> Column:
        if v not in tagged:
            return F.coalesce(F.col(f"_p.{v}"), F.col(f"_v.{v}"))
        return tags_patched(F.coalesce(f"_v.{v}", empty), F.coalesce(f"_p.{v}", empty))

    is_open = F.col("end_datetime") == last
    both = versions.where(is_open).select(*KEYS, F.col("start_datetime").alias("_s"), F.struct(*values).alias("_v")).join(p, list(KEYS), "full_outer")
    hit = F.col("_p").isNotNull()
    old = F.when(F.col("_v").isNotNull(), F.struct(F.col("_s").alias("s"), F.when(hit, at - tick()).otherwise(last).alias("e"), F.struct(*[F.col(f"_v.{v}").alias(v) for v in values]).alias("v")))
    new = F.when(hit & ~F.col("_gone"), F.struct(at.alias("s"), last.alias("e"), F.struct(*[merged(v).alias(v) for v in values]).alias("v")))
    rows = both.select(*KEYS, F.explode(F.filter(F.array(old, new), lambda r: r.isNotNull())).alias("r"))
    rows = rows.select(*KEYS, F.col("r.s").alias("start_datetime"), F.col("r.e").alias("end_datetime"), *[F.col(f"r.v.{v}").alias(v) for v in values])
    return versions.where(~is_open).select(*rows.columns).unionByName(rows)


def metadata_history(snapshots: DataFrame) -> DataFrame:
    """Intervals of grid metadata from (customer_id, taken, metadata, cols): a new one only where either changed."""
    return history(snapshots, F.struct(*[F.col(c) if snapshots.schema[c].dataType.typeName() != "map" else F.array_sort(F.map_entries(c)) for c in ("metadata", "cols")]), ("customer_id",))


def at_each_time(events: DataFrame, versions: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Joins each event to the version of its entity that was in force then (none: nulls)."""
    v = versions.drop(*[c for c in KEYS if c not in keys and c in versions.columns])
    held = F.lit(True)
    for k in keys:
        held = held & (events[k] == v[k])
    held = held & (v["start_datetime"] <= events[time]) & (events[time] <= v["end_datetime"])
    return events.join(v, held, "left").drop(*[v[k] for k in keys])


#: Events of a key from which its time is cut into buckets, and the share of all events; so there are at most 1,000 such keys.
HOT, HOTS = 100_000, 1_000


def at_each_time_in_buckets(events: DataFrame, versions: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("id",), hot: int = HOT) -> DataFrame:
    """The same as at_each_time, where a key may hold any share of the events: its time is cut into buckets of about `hot` events.

    A hot key's versions go into every bucket that they overlap, and events meet them by key and bucket, so the key is
    dealt over as many tasks as it has buckets. Other keys have one bucket. The times of hot keys are one row each, and at
    most HOTS, so they are copied to the tasks.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    total = events.count()
    each = events.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(us(time)).alias("_lo"), F.max(us(time)).alias("_hi"))
    size = max(hot, total // HOTS)
    width = F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("_n") / size)))
    cut = F.broadcast(each.where(F.col("_n") > size).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lo", "_hi", width.cast("bigint").alias("_width")))

    def with_cut(df: DataFrame) -> DataFrame:
        held = F.lit(True)
        for i, k in enumerate(keys):
            held = held & (df[k] == cut[f"_k{i}"])
        return df.join(cut, held, "left").drop(*[f"_k{i}" for i in range(len(keys))])

    bucket = lambda at: F.coalesce(F.floor((F.least(F.greatest(at, F.col("_lo")), F.col("_hi")) - F.col("_lo")) / F.col("_width")), F.lit(0))
    asked = with_cut(events).withColumn("_bucket", bucket(us(time))).drop("_lo", "_hi", "_width")
    v = versions.drop(*[c for c in KEYS if c not in keys and c in versions.columns])
    there = with_cut(v).where(F.col("_lo").isNull() | (us("start_datetime") <= F.col("_hi")) & (us("end_datetime") >= F.col("_lo")))
    there = there.withColumn("_bucket", F.explode(F.sequence(bucket(us("start_datetime")), bucket(us("end_datetime"))))).drop("_lo", "_hi", "_width")
    held = asked["_bucket"] == there["_bucket"]
    for k in keys:
        held = held & (asked[k] == there[k])
    held = held & (there["start_datetime"] <= asked[time]) & (asked[time] <= there["end_datetime"])
    return asked.join(there, held, "left").drop(asked["_bucket"], there["_bucket"], *[there[k] for k in keys])


def at_each_time_by_window(events: DataFrame, versions: DataFrame, value: str, time: str = "ts", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The same for one value column by union and window, where a key has very many versions and events."""
    there = versions.select(*keys, F.col("start_datetime").alias(time), F.lit(0).alias("_kind"), F.struct(F.col(value), F.col("end_datetime")).alias("_v"))
    asked = events.withColumn("_kind", F.lit(1))
    both = there.unionByName(asked, allowMissingColumns=True)
    last = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_v", last).where("_kind = 1")
    return out.withColumn(value, F.when(F.col(time) <= F.col("_v.end_datetime"), F.col(f"_v.{value}"))).drop("_kind", "_v")


def latest(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key; partial sums, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def purged(versions: DataFrame, tenant: str) -> DataFrame:
    """Everything but one tenant's rows, as before an import that resets it."""
    return versions.where(~F.col("customer_id").eqNullSafe(F.lit(tenant)))


SNAPSHOT_NAME = r"^(.*?)(?:-(\d{4}-\d\d-\d\d(?:T\d\d[:_]?\d\d(?:[:_]?\d\d)?)?))?\.(hayson\.json|zinc|trio|json|csv)(?:\.gz)?$"


def snapshot_files(files: DataFrame) -> DataFrame:
    """(path, modified) -> name, version, suffix: what a file's name says of its version; an undated one has its file's time."""
    base = F.element_at(F.split(F.regexp_replace("path", r"/part-[^/]*$", ""), "/"), -1)
    dated = F.nullif(F.regexp_extract(base, SNAPSHOT_NAME, 2), F.lit(""))
    time = F.regexp_replace(F.regexp_replace(dated, "_", ":"), r"T(\d\d)(\d\d)", "T$1:$2").try_cast("timestamp")
    return files.select("path", F.regexp_extract(base, SNAPSHOT_NAME, 1).alias("name"), F.coalesce(time, F.col("modified")).alias("version"), F.regexp_extract(base, SNAPSHOT_NAME, 3).alias("suffix"))


def newest_snapshot(files: DataFrame, when: str) -> DataFrame:
    """For each name the file of its newest version up to a time."""
    rows = snapshot_files(files).where(F.col("version") <= F.lit(when).cast("timestamp"))
    return rows.groupBy("name").agg(F.max_by("path", "version").alias("path"), F.max("version").alias("version"))


def snapshot_intervals(files: DataFrame) -> DataFrame:
    """Every file with the interval in which it is the newest of its name."""
    rows = snapshot_files(files).withColumnRenamed("version", "start_datetime")
    return closed(rows, ("name",))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified) of the files below a path; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"))


def import_snapshots(entities: DataFrame, files: DataFrame, tenant: str = "") -> DataFrame:
    """Intervals of all entities from all snapshot files: entities(file, id, tags) as read, files(path, modified) as listed.

    The files of one name are snapshots of one ontology; an entity gets a new version where its tags changed, and ends
    where a snapshot lacks it. Parts of one file count as one snapshot.
    """
    path = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), r"/part-[^/]*$", "")
    named = snapshot_files(files.groupBy(path(F.col("path")).alias("path")).agg(F.max("modified").alias("modified")))
    rows = entities.withColumn("path", path(F.col("file"))).join(named.select("path", "name", F.col("version").alias("taken")), "path")
    rows = rows.select(F.lit(tenant).alias("customer_id"), "name", "id", "taken", "tags")
    times = named.select(F.lit(tenant).alias("customer_id"), "name", F.col("version").alias("taken"))
    return history(rows, tag_hash(F.col("tags")), ("customer_id", "name", "id"), scope=("customer_id", "name"), times=times)
