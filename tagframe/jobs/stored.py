"""Series and versions on disk, changed in place: a job reads and overwrites only the partitions that it touches.

Every row of a series carries the number of the batch that wrote it, and a deleted point stays as a row that is not
there. Of the rows of one point the one with the greatest number counts, so a batch that is written again, whole or after
a job that died half-way, changes nothing, and neither does an older one that comes late. Open versions lie in buckets,
each of which notes the last merge that it has seen; closed versions are only ever added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kinds
from ..operators.diff import GONE, tags_patched
from .versions import END, KEYS, tick

BATCH, THERE, MERGE = "_batch", "_there", "_merge"
#: Files of a day that a write makes at most; a series may be in several.
FILES = 16
#: Buckets of open versions.
BUCKETS = 64


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _values(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in df.columns if c not in (*keys, BATCH, THERE, "day")]


def _point_keys(df: DataFrame) -> list[str]:
    return [c for c in ("customer_id", "id", "ts") if c in df.columns]


def _put(df: DataFrame, path: str) -> None:
    spread = F.pmod(F.xxhash64("id", F.hour("ts")), F.lit(FILES))
    _overwrite(df.withColumn("day", F.to_date("ts")).repartition("day", spread).sortWithinPartitions("day", "id", "ts"), path, "day")


def _numbered(points: DataFrame, batch: int, there: bool = True) -> DataFrame:
    return points.withColumns({BATCH: F.lit(batch).cast("bigint"), THERE: F.lit(there)})


def _newest(rows: DataFrame) -> DataFrame:
    """One row for each point: that of the greatest batch; of one batch a row that is there, then the greatest values."""
    keys = _point_keys(rows)
    rest = _values(rows, keys)
    order = F.struct(BATCH, THERE, F.to_json(F.struct(*rest)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, BATCH, THERE), order).alias("_r")).select(*keys, "_r.*")


def create_series(points: DataFrame, path: str) -> None:
    """A series table of points(customer_id, id, ts, ...); repeated points count once. Rows without ts are left out."""
    _put(_newest(_numbered(points.where("ts IS NOT NULL"), 0)), path)


def _all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """The points that are there, with their day, by which a scan is pruned."""
    return _all(spark, path).where(THERE).drop(BATCH, THERE)


def _touched(spark: SparkSession, path: str, points: DataFrame) -> DataFrame:
    """All rows of the days that points lie on. The days, one value each, decide before anything else is read."""
    days = [r[0] for r in points.select(F.to_date("ts")).distinct().collect()]
    return _all(spark, path).where(F.col("day").isin(days)).drop("day")


def write_points(points: DataFrame, path: str, batch: int) -> None:
    """Adds points, or gives them new values; only their days are read and overwritten. batch: above 0, and growing."""
    points = points.where("ts IS NOT NULL")
    old = _touched(points.sparkSession, path, points)
    _put(_newest(old.unionByName(_numbered(points, batch).select(*old.columns))), path)


def replace_period(points: DataFrame, path: str, batch: int) -> None:
    """Points of an id between its first and its last new one (both included) give way to the new ones.

    Days that lie between, without a new point of their own, are touched too.
    """
    spark, points = points.sparkSession, points.where("ts IS NOT NULL")
    keys = [k for k in _point_keys(points) if k != "ts"]
    bounds = points.groupBy(*keys).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    days = bounds.select(F.explode(F.sequence(F.to_date("_lo"), F.to_date("_hi"))).alias("day")).distinct()
    old = _all(spark, path).where(F.col("day").isin([r[0] for r in days.collect()])).drop("day")
    gone = old.join(bounds, keys).where(F.col("ts").between(F.col("_lo"), F.col("_hi")) & (F.col(BATCH) < batch) & F.col(THERE)).select(*old.columns)
    gone = _numbered(gone, batch, there=False)
    _put(_newest(old.unionByName(gone.select(*old.columns)).unionByName(_numbered(points, batch).select(*old.columns))), path)


def prepend_older(points: DataFrame, path: str, batch: int) -> None:
    """Adds those points that are older than the first one of their id; all, where an id has none.

    What this batch has written before it died does not count as there, so it can be written again.
    """
    spark, points = points.sparkSession, points.where("ts IS NOT NULL")
    keys = [k for k in _point_keys(points) if k != "ts"]
    first = _all(spark, path).where(F.col(THERE) & (F.col(BATCH) < batch)).groupBy(*keys).agg(F.min("ts").alias("_first"))
    older = points.join(first, keys, "left").where(F.col("_first").isNull() | (F.col("ts") < F.col("_first"))).select(*points.columns)
    write_points(older, path, batch)


def point_sink(path: str, first: int = 1) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes points; a batch that the stream gives again changes nothing.

    first: the number of the stream's batch 0. A stream that starts anew, with another checkpoint, needs a greater one
    than the table holds (last_batch).
    """

    def run(points: DataFrame, number: int) -> None:
        write_points(points, path, first + number)

    return run


def last_batch(spark: SparkSession, path: str) -> int:
    return _all(spark, path).agg(F.max(BATCH)).first()[0] or 0


# versions


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int")


def _is_open() -> Column:
    return F.col("end_datetime") == F.lit(END).cast("timestamp")


def _put_open(rows: DataFrame, path: str, merge: int, buckets: list[int]) -> None:
    """Overwrites buckets of open versions; each gets a row that says so, so that one without versions is overwritten, too."""
    marks = rows.sparkSession.createDataFrame([(b, False) for b in buckets], f"bucket int, {THERE} boolean")
    both = rows.withColumn("bucket", _bucket()).withColumn(THERE, F.lit(True)).unionByName(marks, allowMissingColumns=True)
    _overwrite(both.withColumn(MERGE, F.lit(merge).cast("bigint")).repartition("bucket").sortWithinPartitions("bucket", *KEYS), f"{path}/open", "bucket")


def create_versions(versions: DataFrame, path: str) -> None:
    """A table of versions (customer_id, id, start_datetime, end_datetime, ...): open ones in buckets, closed ones by merge."""
    _put_open(versions.where(_is_open()), path, 0, list(range(BUCKETS)))
    _put_closed(versions.where(~_is_open()), path, 0)


def _put_closed(rows: DataFrame, path: str, merge: int) -> None:
    _overwrite(rows.withColumns({MERGE: F.lit(merge).cast("bigint"), "bucket": _bucket()}).repartition("bucket"), f"{path}/closed", MERGE, "bucket")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    held = spark.read.parquet(f"{path}/open").where(THERE).drop(THERE, MERGE, "bucket")
    return held.unionByName(spark.read.schema(held.schema).parquet(f"{path}/closed").select(*held.columns))


def folded(held: DataFrame, patches: DataFrame, gone: Column | None = None) -> DataFrame:
    """Open versions and patches(customer_id, id, at, ...) of many times -> all versions that come of them, in one shuffle.

    The patches of a key apply in the order of `at`, which must lie behind the start of the open version and differ within
    the key. Their columns replace those before where they are not null; tag maps are patched tag by tag. Where `gone` holds,
    or tags have `remove_`, the entity ends, and a later patch begins it anew.
    """
    values = [c for c in held.columns if c not in (*KEYS, "start_datetime", "end_datetime")]
    tagged = [v for v in values if held.schema[v].dataType == kinds.TAGS]
    leaves = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    for v in tagged:
        if v in patches.columns:
            leaves = leaves | F.coalesce(F.map_contains_key(v, F.lit(GONE)), F.lit(False))
    base = held.select(*KEYS, F.col("start_datetime").alias("at"), F.lit(False).alias("_gone"), *values)
    rows = base.unionByName(patches.select(*KEYS, F.col("at").cast("timestamp").alias("at"), leaves.alias("_gone"), *[(F.col(v) if v in patches.columns else F.lit(None)).cast(held.schema[v].dataType).alias(v) for v in values]))
    own = Window.partitionBy(*KEYS).orderBy("at")
    rows = rows.withColumn("_next", F.lead("at").over(own))
    rows = rows.withColumn("_life", F.coalesce(F.sum(F.col("_gone").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    life = Window.partitionBy(*KEYS, "_life").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    empty = F.create_map().cast(kinds.TAGS)
    for v in values:
        if v in tagged:
            rows = rows.withColumn(v, F.aggregate(F.collect_list(v).over(life), empty, lambda done, p: tags_patched(done, p)))
        else:
            rows = rows.withColumn(v, F.last(v, ignorenulls=True).over(life))
    end = F.coalesce(F.col("_next") - tick(), F.lit(END).cast("timestamp"))
    return rows.where(~F.col("_gone")).select(*KEYS, F.col("at").alias("start_datetime"), end.alias("end_datetime"), *values)


def merge_patches(patches: DataFrame, path: str, merge: int, gone: Column | None = None) -> None:
    """Applies patches of one or many times to a table of versions. merge: above 0, and growing.

    Only the buckets with patched keys are read and overwritten; what closes is added. A merge that is repeated, or that
    died between its writes, applies once: buckets that have seen it are left alone.
    """
    spark = patches.sparkSession
    touched = sorted(r[0] for r in patches.select(_bucket()).distinct().collect())
    held = spark.read.parquet(f"{path}/open").where(F.col("bucket").isin(touched))
    seen = {r[0] for r in held.where(F.col(MERGE) >= merge).select("bucket").distinct().collect()}
    todo = [b for b in touched if b not in seen]
    if not todo:
        return
    held = held.where(F.col("bucket").isin(todo) & F.col(THERE)).drop(THERE, MERGE, "bucket")
    rows = folded(held, patches.where(_bucket().isin(todo)), gone)
    _put_closed(rows.where(~_is_open()), path, merge)
    _put_open(rows.where(_is_open()), path, merge, todo)
