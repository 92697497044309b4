"""Time series: tables (customer_id, id, ts, val, ...), for one point or for all of them in one job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinds
from ..functions.ranges import period_lists
from ..sources.shared import shared_path


def read(series: DataFrame, start: Column | str | None = None, end: Column | str | None = None, version: str | None = None, ids: list[str] | DataFrame | None = None) -> DataFrame:
    """Points in [start, end), end cut to the version's time; of some ids or of all, in the order of id and time within a task."""
    out = in_range(series, start, end, version)
    if isinstance(ids, DataFrame):
        out = out.join(ids.select("id").distinct(), "id", "left_semi")
    elif ids is not None:
        out = out.where(F.col("id").isin(ids))
    return out


def in_range(series: DataFrame, start: Column | str | None = None, end: Column | str | None = None, version: str | None = None) -> DataFrame:
    """The filter alone; it reaches the scan as it compares the bare column."""
    kind = series.schema["ts"].dataType
    at = lambda x: x if isinstance(x, Column) else F.lit(x).cast(kind)
    out = series if start is None else series.where(F.col("ts") >= at(start))
    out = out if end is None else out.where(F.col("ts") < at(end))
    return out if version is None else out.where(F.col("ts") < at(version))


def by_time(series: DataFrame, *keys: str) -> DataFrame:
    """Each series together and in the order of time; a shuffle by id and a sort in each task."""
    keys = keys or ("id",)
    return series.repartition(*keys).sortWithinPartitions(*keys, "ts")


def bounds(series: DataFrame, ids: DataFrame | None = None, default: Column | str | None = None) -> DataFrame:
    """(id, his_start, his_end, points); ids without points have the default as both bounds."""
    out = series.groupBy("id").agg(F.min("ts").alias("his_start"), F.max("ts").alias("his_end"), F.count("*").alias("points"))
    if ids is None:
        return out
    fill = F.lit(default).cast(series.schema["ts"].dataType) if not isinstance(default, Column) else default
    out = ids.select("id").distinct().join(out, "id", "left")
    return out.select("id", F.coalesce("his_start", fill).alias("his_start"), F.coalesce("his_end", fill).alias("his_end"), F.coalesce("points", F.lit(0)).alias("points"))


def of_entities(series: DataFrame, entities: DataFrame) -> DataFrame:
    """Points of the entities that a filter kept."""
    return series.join(entities.select("id").distinct(), "id", "left_semi")


def with_history(entities: DataFrame, series: DataFrame) -> DataFrame:
    """Entities with the number of their points."""
    return entities.join(series.groupBy("id").agg(F.count("*").alias("points")), "id", "left").withColumn("points", F.coalesce("points", F.lit(0)))


def numeric_series(series: DataFrame, kind: str = "kind") -> DataFrame:
    """(id, numeric): whether all values of a series are numbers."""
    return series.groupBy("id").agg(((F.min(kind) == F.max(kind)) & (F.max(kind) == "number")).alias("numeric"))


def typed_casts(series: DataFrame, val: str = "val") -> DataFrame:
    """Adds a typed reading of a TAG_VALUE column for each type."""
    return series.select("*", *[kinds.typed(F.col(val), n).alias(n) for n in ("int", "float", "str", "bool", "uri", "ref", "date", "time", "datetime", "coord")])


def period_replaced(series: DataFrame, new: DataFrame) -> DataFrame:
    """Import: points of an id between the first and the last new point (both included) give way to the new ones.

    The bounds are one row for each id, joined on the id; the range is only a filter on the joined row.
    """
    keys = ["customer_id", "id"] if "customer_id" in series.columns and "customer_id" in new.columns else ["id"]
    b = new.groupBy(*keys).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    kept = series.join(b, keys, "left").where(F.col("_lo").isNull() | (F.col("ts") < F.col("_lo")) | (F.col("ts") > F.col("_hi"))).select(*series.columns)
    return kept.unionByName(new.select(*series.columns))


def older_prepended(destination: DataFrame, source: DataFrame) -> DataFrame:
    """Merge that forgets nothing: the destination, and source points older than its first one of the same id."""
    first = destination.groupBy("id").agg(F.min("ts").alias("_first"))
    older = source.join(first, "id", "left").where(F.col("_first").isNull() | (F.col("ts") < F.col("_first"))).select(*destination.columns)
    return destination.unionByName(older)


def from_sources(**sources: DataFrame) -> DataFrame:
    """Series of several sources for display: one table with a column source."""
    out = None
    for name, df in sources.items():
        one = df.withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def newest_first(series: DataFrame) -> DataFrame:
    return series.orderBy("id", "source", F.desc("ts"))


def placed(rows: DataFrame) -> DataFrame:
    """Sorted rows with their place in that order, from 0: the rows of the parts before, and the place within the part.

    Rows are written once: a part must hold the same rows where it is counted and where its rows get their places, and a
    second sort may cut its ranges elsewhere.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "placed")
    numbered = rows.withColumn("_n", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    part = F.shiftright("_n", 33).alias("_p")
    stored = spark.read.schema(numbered.schema).parquet(path).withColumn("_p", part)
    sizes = stored.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    ahead = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_a"))
    return stored.join(F.broadcast(ahead), "_p").withColumn("place", F.col("_a") + F.expr("_n & 8589934591")).drop("_p", "_n", "_a")


#: The store's column for each kind.
STORE_TYPES = {"str": "VARCHAR", "uri": "VARCHAR", "bin": "VARCHAR", "ref": "VARCHAR", "coord": "VARCHAR", "xstr": "VARCHAR", "number": "DOUBLE", "bool": "BOOLEAN", "marker": "BOOLEAN", "na": "BOOLEAN", "remove": "BOOLEAN", "null": "BOOLEAN", "date": "BIGINT", "time": "BIGINT", "datetime": "BIGINT"}
_ORDINAL = 719163  # days from 0001-01-01, counted as 1, to 1970-01-01


def _micros_of_day(text: Column) -> Column:
    p = F.split(text, ":")
    return F.round((p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")) * 1_000_000).cast("bigint")


def to_store(series: DataFrame) -> DataFrame:
    """TAG_VALUE series -> hs_type, unit and one typed column; the kind of a series is that of its first value in time.

    Values of another kind than their series' give null.
    """
    first = series.groupBy("id").agg(F.min_by(F.struct(F.coalesce("val.kind", F.lit("null")).alias("kind"), F.col("val.unit").alias("unit")), "ts").alias("_f"))
    rows = series.join(first, "id").withColumn("_k", F.col("_f.kind"))
    v, k = F.col("val"), F.col("_k")
    fits = F.coalesce(v["kind"], F.lit("null")) == k
    store = F.create_map(*[F.lit(x) for pair in STORE_TYPES.items() for x in pair])[k]
    text = F.when(k == "xstr", F.concat(F.lit("hex,"), F.lower(v["str"]))).otherwise(v["str"])
    whole = F.when(k == "date", F.datediff(v["str"].try_cast("date"), F.lit("1970-01-01")) + _ORDINAL).when(k == "time", _micros_of_day(v["str"])).when(k == "datetime", F.unix_seconds(v["ts"]))
    flag = F.when(k == "bool", v["str"] == "true").when(k == "null", F.lit(False)).otherwise(F.lit(True))
    keep = [c for c in series.columns if c != "val"]
    return rows.select(
        *keep,
        k.alias("hs_type"),
        F.when(k == "number", F.col("_f.unit")).alias("unit"),
        store.alias("store_type"),
        F.when(fits & (store == "VARCHAR"), text).alias("val_varchar"),
        F.when(fits & (store == "DOUBLE"), v["num"]).alias("val_double"),
        F.when(fits & (store == "BOOLEAN"), flag).alias("val_boolean"),
        F.when(fits & (store == "BIGINT"), whole.cast("bigint")).alias("val_bigint"),
    )


def from_store(stored: DataFrame) -> DataFrame:
    """The typed store's rows -> TAG_VALUE series."""
    k, text, whole, flag = F.col("hs_type"), F.col("val_varchar"), F.col("val_bigint"), F.col("val_boolean")
    seconds = whole / 1_000_000
    clock = F.concat(F.lpad(F.floor(seconds / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(seconds % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"))
    part = whole % 1_000_000
    clock = F.when(part > 0, F.concat(clock, F.lit("."), F.lpad(part.cast("string"), 6, "0"))).otherwise(clock)
    value = (
        F.when(k == "number", kinds.number(F.col("val_double"), F.col("unit")))
        .when(k == "bool", F.when(flag.isNotNull(), kinds.value("bool", flag.cast("string"), num=flag.cast("double"))))
        .when(k == "marker", kinds.marker(flag))
        .when(k == "na", F.when(flag, kinds.value("na", F.lit("NA"))))
        .when(k == "remove", F.when(flag, kinds.removed()))
        .when(k == "date", F.when(whole.isNotNull(), kinds.value("date", F.date_add(F.lit("1970-01-01").cast("date"), (whole - _ORDINAL).cast("int")).cast("string"))))
        .when(k == "time", F.when(whole.isNotNull(), kinds.value("time", clock)))
        .when(k == "datetime", kinds.datetime(F.timestamp_seconds(whole)))
        .when(k == "xstr", F.when(text.isNotNull(), kinds.value("xstr", F.upper(F.element_at(F.split(text, ","), -1)), unit=F.lit("hex"))))
        .when(k == "null", F.lit(None).cast(kinds.TAG_VALUE))
        .otherwise(F.when(text.isNotNull(), kinds.value(k, text)))
    )
    keep = [c for c in stored.columns if c not in ("hs_type", "unit", "store_type", "val_varchar", "val_double", "val_boolean", "val_bigint")]
    return stored.select(*keep, value.alias("val"))


def with_target_column(stored: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds the column that a point's `kind` tag (Number where it has none) says to read."""
    kind = F.lower(F.coalesce("kind", F.lit("Number")))
    names = F.create_map(*[F.lit(x) for pair in {**STORE_TYPES, "number": "DOUBLE"}.items() for x in pair])
    return stored.join(entities.select("id", kind.alias("_kind")), "id", "left").withColumn("target", F.coalesce(names[F.col("_kind")], F.lit("DOUBLE"))).drop("_kind")


#: Date patterns of the lake's time column in Spark's letters.
_STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD", "%b": "MMM", "%z": "xx", "%Z": "zzz", "%p": "a", "%I": "hh"}


def java_pattern(pattern: str) -> str:
    out, at = "", 0
    while at < len(pattern):
        if pattern[at] == "%":
            out += _STRPTIME[pattern[at : at + 2]]
            at += 2
        else:
            out += f"'{pattern[at]}'" if pattern[at].isalpha() else pattern[at]
            at += 1
    return out


def _in_period(df: DataFrame, keys: Mapping, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """The partitions of a table by year, month and day (keys: year_col, month_col, day_col) that a period touches."""
    parts = {n: F.col(keys[n]).cast("int") if df.schema[keys[n]].dataType.typeName() == "string" else F.col(keys[n]) for n in ("year_col", "month_col", "day_col") if keys.get(n)}
    for name, values in zip(("year_col", "month_col", "day_col"), period_lists(start, end), strict=True):
        if name in parts:
            df = df.where(parts[name].isin(values))
    if len(parts) == 3:  # of the days that the lists make together, those of the period
        number = parts["year_col"] * 10_000 + parts["month_col"] * 100 + parts["day_col"]
        df = df.where(number.between(int(start.strftime("%Y%m%d")), int(end.strftime("%Y%m%d"))))
    return df


#: What describes a point's place in the lake: the table, fixed partition keys, and the rest as read_lake() takes it.
LAKE = "id string, path string, partition_keys map<string, string>, date_part_keys map<string, string>, hs_value_column map<string, string>, hs_date_column map<string, string>"


def read_lake_all(described: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """(id, ts, val) of all points that `described` (columns of LAKE) names, in [start, end): one scan for each table.

    Points of a table that are read alike are one join on its partition keys, so their rows prune the scan while it
    runs, and the period prunes it before. Values are TAG_VALUE: one column by its type, several as a dict. The different
    tables and ways to read them, not the points, are listed on the driver.
    """
    spark, how = described.sparkSession, ["path", "date_part_keys", "hs_value_column", "hs_date_column"]
    text = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    way = F.sha2(F.concat_ws("|", "path", *[text(c) for c in how[1:]], F.array_join(F.array_sort(F.map_keys("partition_keys")), ",")), 256)
    rows, out = described.withColumn("_way", way), None
    for r in rows.groupBy("_way").agg(*[F.first(c).alias(c) for c in (*how, "partition_keys")]).collect():
        table = _in_period(spark.read.parquet(r.path), r.date_part_keys or {}, start, end)
        keys = sorted(r.partition_keys or {})
        mine = rows.where(F.col("_way") == r._way).select("id", *[F.col("partition_keys")[k].alias(f"_{k}") for k in keys])
        held = F.lit(True)
        for k in keys:
            held = held & (table[k] == mine[f"_{k}"].cast(table.schema[k].dataType))
        met = table.join(mine, held) if keys else table.withColumn("_one", F.lit(1)).join(mine.withColumn("_one", F.lit(1)), "_one")  # a table of one point
        one = lake_values(met, {"hs_value_column": r.hs_value_column, "hs_date_column": r.hs_date_column}, "id")
        one = one.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
        one = one.withColumn("val", _tagged(one.schema["val"].dataType)).select("id", "ts", "val").distinct()
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], described.select("id").schema).select("id", F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast(kinds.TAG_VALUE).alias("val")) if out is None else out


def _tagged(kind: T.DataType, c: str = "val") -> Column:
    """A typed value as TAG_VALUE; a struct as a dict, without the fields that are null."""

    def one(v: Column, t: T.DataType) -> Column:
        if isinstance(t, T.NumericType):
            return kinds.number(v)
        if isinstance(t, T.BooleanType):
            return F.when(v.isNotNull(), kinds.value("bool", v.cast("string"), num=v.cast("double")))
        if isinstance(t, T.DateType):
            return F.when(v.isNotNull(), kinds.value("date", v.cast("string")))
        return kinds.datetime(v) if isinstance(t, T.TimestampType) else kinds.string(v.cast("string"))

    if not isinstance(kind, T.StructType):
        return one(F.col(c), kind)
    there = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f.name) for f in sorted(kind, key=lambda f: f.name)]), F.array(*[kinds.encode_tagged(one(F.col(c)[f.name], f.dataType)) for f in sorted(kind, key=lambda f: f.name)])), lambda k, v: v.isNotNull())
    return kinds.value("dict", F.to_json(there))


def read_lake(spark: SparkSession, path: str, spec: Mapping, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Distinct points in [start, end) of a lake table that partitions by fixed keys and by year, month and day.

    spec: partition_keys ("k1='v1'/k2='v2'"), date_part_keys (year_col, month_col, day_col), hs_value_column (column ->
    type), hs_date_column (column -> strptime pattern). The partition lists prune the scan; the exact range follows.
    """
    df = spark.read.parquet(path)
    for part in filter(None, spec.get("partition_keys", "").split("/")):
        k, v = part.split("=", 1)
        df = df.where(F.col(k) == F.lit(v.strip("'")).cast(df.schema[k].dataType))
    df = _in_period(df, spec.get("date_part_keys", {}), start, end)
    return lake_values(df, spec).where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))).distinct()


def lake_values(rows: DataFrame, spec: Mapping, *keep: str) -> DataFrame:
    """(columns to keep, ts, val): one value column as it is, several as a struct; times parsed by their pattern and cut to the second."""
    (column, pattern), *_ = spec["hs_date_column"].items()
    parsed = F.to_timestamp(column, java_pattern(pattern)) if rows.schema[column].dataType.typeName() == "string" else F.col(column).cast("timestamp")
    types = {"float": "double", "int": "bigint", "number": "double", "bool": "boolean", "str": "string", "date": "date", "datetime": "timestamp"}
    values = [F.col(c).try_cast(types.get(t.lower(), "string")).alias(c) for c, t in spec["hs_value_column"].items()]
    return rows.select(*keep, F.date_trunc("second", parsed).alias("ts"), (values[0] if len(values) == 1 else F.struct(*values)).alias("val"))


def import_files(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Points of all entities whose `hisURI` names a file: files has path, ts and val; one scan for all of them."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("hisURI", name).join(entities.select("id", "hisURI").where("hisURI IS NOT NULL"), "hisURI").select("id", "ts", "val")


def import_all(entities: DataFrame, grids: DataFrame, tenant: str = "", stored: DataFrame | None = None) -> DataFrame:
    """Bulk import: (customer_id, id, ts, val) of the points of all entities(id, tags), in one job.

    Points are rows with ts and val in the grids(file, tags) that the entities' `hisURI` tags name, or lie in nested grids
    of their `history` tags. stored: points that are there already; those of a period that is imported give way.
    """
    named = entities.select("id", F.col("tags")["hisURI"]["str"].alias("hisURI"))
    rows = grids.select(F.col("file").alias("path"), F.col("tags")["ts"]["ts"].alias("ts"), F.col("tags")["val"].alias("val")).where("ts IS NOT NULL")
    points = import_files(named, rows).unionByName(import_nested(entities)).select(F.lit(tenant).alias("customer_id"), "id", "ts", "val")
    return points if stored is None else period_replaced(stored, points)


def import_nested(entities: DataFrame, column: str = "history") -> DataFrame:
    """(id, ts, val) of entities that hold their points: an array column of (ts, val), or a tag whose value is a nested grid."""
    if column in entities.columns:
        return entities.select("id", F.inline(column))
    held = entities.select("id", F.col("tags")[column].alias("v")).where("v.kind = 'grid'")
    rows = held.select("id", F.explode(F.from_json("v.str", "rows ARRAY<MAP<STRING, STRING>>").rows).alias("row"))
    return rows.select("id", kinds.decode_tagged(F.col("row")["ts"])["ts"].alias("ts"), kinds.decode_tagged(F.col("row")["val"]).alias("val"))


def last_per_level(writes: DataFrame, now: Column | str) -> DataFrame:
    """Priority arrays from point writes (id, level, val, who, at, duration_s): the last write per level that still holds.

    A null val gives the level back; a duration ends it. level 1 to 17; the lowest level that holds is in force.
    """
    at = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    last = writes.groupBy("id", "level").agg(F.max_by(F.struct("val", "who", "at", "duration_s"), "at").alias("w"))
    ends = F.timestamp_micros(F.unix_micros(F.col("w.at")) + F.col("w.duration_s").cast("bigint") * 1_000_000)
    held = last.where(F.col("w.val").isNotNull() & (F.col("w.duration_s").isNull() | (ends >= at)))
    lowest = F.min("level").over(Window.partitionBy("id"))
    return held.select("id", "level", F.concat(F.lit("level "), F.col("level").cast("string")).alias("levelDis"), F.col("w.val").alias("val"), F.col("w.who").alias("who"), (F.col("level") == lowest).alias("in_force"))
