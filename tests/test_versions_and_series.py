import datetime as dt

import pytest
from pyspark.sql import functions as F

from tagframe.functions import kinds, ranges, tz, units
from tagframe.jobs import series as ts
from tagframe.jobs import versions as ver
from tagframe.operators import diff

UTC = dt.timezone.utc


def at(text):
    return dt.datetime.fromisoformat(text)


def test_history_from_snapshots(spark):
    rows = [("c", "a", 1, "x"), ("c", "a", 2, "x"), ("c", "a", 3, "y"), ("c", "b", 1, "p"), ("c", "b", 3, "p"), ("d", "a", 1, "x")]
    df = spark.createDataFrame(rows, "customer_id string, id string, n int, v string").withColumn("taken", F.timestamp_seconds(F.col("n") * 86400)).drop("n")
    got = {(r.customer_id, r.id, r.v, r.start_datetime.day, r.end_datetime.year) for r in ver.history(df, F.col("v")).collect()}
    assert got == {("c", "a", "x", 2, 1970), ("c", "a", "y", 4, 9999), ("c", "b", "p", 2, 1970), ("c", "b", "p", 4, 9999), ("d", "a", "x", 2, 9999)}
    v = ver.history(df, F.col("v"))
    assert {(r.id, r.v) for r in ver.as_of(v, "1970-01-03 12:00:00", "c").collect()} == {("a", "x")}
    pairs = v.alias("p").join(v.alias("q"), ["customer_id", "id"]).where("p.start_datetime < q.start_datetime AND p.end_datetime >= q.start_datetime")
    assert pairs.count() == 0


def test_changes_close_and_open(spark):
    start = spark.createDataFrame([("c", "a", at("2020-01-01"), 1, "k"), ("c", "b", at("2020-01-01"), 2, "k"), ("c", "z", at("2020-01-01"), 3, "k")], "customer_id string, id string, start_datetime timestamp, v int, w string")
    patch = spark.createDataFrame([("c", "a", 5, False), ("c", "b", None, True), ("c", "n", 9, False), ("c", "m", 1, True)], "customer_id string, id string, v int, gone boolean")
    got = {(r.id, r.v, r.w, r.start_datetime.year, r.end_datetime.year) for r in ver.changed(ver.closed(start), patch, "2021-06-01 00:00:00", F.col("gone")).collect()}
    assert got == {("a", 1, "k", 2020, 2021), ("a", 5, "k", 2021, 9999), ("b", 2, "k", 2020, 2021), ("z", 3, "k", 2020, 9999), ("n", 9, None, 2021, 9999)}


def test_point_in_time_joins_agree(spark):
    v = ver.closed(spark.createDataFrame([("c", "a", at("2020-01-01"), "1"), ("c", "a", at("2020-02-01"), "2"), ("c", "b", at("2020-01-15"), "3")], "customer_id string, id string, start_datetime timestamp, s string"))
    e = spark.createDataFrame([("a", at("2019-12-31")), ("a", at("2020-01-01")), ("a", at("2020-01-31T23:59:59.999999")), ("a", at("2020-02-01")), ("b", at("2020-01-01")), ("q", at("2020-01-01"))], "id string, ts timestamp")
    one = sorted((r.id, r.ts, r.s or "") for r in ver.at_each_time(e, v).select("id", "ts", "s").collect())
    two = sorted((r.id, r.ts, r.s or "") for r in ver.at_each_time_by_window(e, v, "s").select("id", "ts", "s").collect())
    assert one == two and [x[2] for x in one] == ["", "1", "1", "2", "", ""]


def test_version_times():
    assert ver.normal_version(dt.date(2020, 1, 2)) == dt.datetime(2020, 1, 2, 23, 59, 59)
    assert ver.normal_version(dt.datetime(2020, 1, 2)) == dt.datetime(2020, 1, 2, 23, 59, 59)
    assert ver.normal_version(dt.datetime(2020, 1, 2, 0, 5)) == dt.datetime(2020, 1, 2, 0, 5)


def test_snapshot_files(spark):
    files = spark.createDataFrame([("/d/town.zinc", at("2021-05-01")), ("/d/town-2020-10-01.zinc", at("2022-01-01")), ("/d/town-2020-11-01T10:00:00.zinc.gz", at("2022-01-01")), ("/d/x.hayson.json", at("2020-01-01"))], "path string, modified timestamp")
    pick = lambda when: {r.name: r.path for r in ver.newest_snapshot(files, when).collect()}
    assert pick("2020-10-15 00:00:00") == {"town": "/d/town-2020-10-01.zinc", "x": "/d/x.hayson.json"}
    assert pick("2020-12-01 00:00:00")["town"].endswith(".gz") and pick("2022-01-01 00:00:00")["town"] == "/d/town.zinc"
    assert ver.snapshot_intervals(files).where("name = 'town'").count() == 3


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("today", "2020-06-15T00:00+02:00", "2020-06-16T00:00+02:00"), ("yesterday", "2020-06-14T00:00+02:00", "2020-06-15T00:00+02:00"), ("2020-12-24", "2020-12-24T00:00+01:00", "2020-12-25T00:00+01:00"), ("2020-12-24,2020-12-25", "2020-12-24T00:00+01:00", "2020-12-25T23:59:59.999999+01:00"),
        ("2020-12-24T10:00:00Z", "2020-12-24T10:00+00:00", None), ("2020-12-24T10:00:00Z,2020-12-25", "2020-12-24T10:00+00:00", "2020-12-25T00:00+01:00"), ("2020-12-24,today", "2020-12-24T00:00+01:00", "2020-06-16T00:00+02:00"), (",2020-12-24", None, "2020-12-24T23:59:59.999999+01:00"), ("2020-12-24,", "2020-12-24T00:00+01:00", None), ("", None, None),
    ],
)
def test_ranges(spark, text, start, end):
    now = dt.datetime(2020, 6, 15, 12, tzinfo=UTC)
    want = (at(start) if start else ranges.FIRST, at(end) if end else ranges.LAST)
    assert ranges.parse_range(text, now, "Europe/Paris") == want
    a, b = ranges.range_columns(F.lit(text), F.lit("2020-06-15 12:00:00").cast("timestamp"))
    got = spark.range(1).select(*[F.date_format(x, "yyyy-MM-dd HH:mm:ss") for x in (a, b)]).first()
    assert list(got) == [x.astimezone(UTC).replace(tzinfo=None).isoformat(" ", "seconds") for x in ranges.parse_range(text, now)]


def test_periods():
    d = dt.date
    assert ranges.period_lists(d(2020, 3, 5), d(2020, 3, 9)) == ([2020], [3], [5, 6, 7, 8, 9])
    years, months, days = ranges.period_lists(d(2020, 12, 30), d(2021, 1, 2))
    assert (years, months, days) == ([2020, 2021], [1, 12], [1, 2, 30, 31])
    assert ranges.period_lists(d(2020, 1, 1), d(2021, 2, 1))[1:] == (list(range(1, 13)), list(range(1, 32)))


def test_store_round_trip(spark):
    v = [kinds.number(F.lit(1.5), F.lit("kW")), kinds.string(F.lit("x")), kinds.value("bool", F.lit("true"), num=F.lit(1.0)), kinds.value("date", F.lit("2021-02-03")), kinds.value("time", F.lit("10:20:30.500000")), kinds.datetime(F.lit("2021-02-03 04:05:06").cast("timestamp")), kinds.ref(F.lit("r")), kinds.value("coord", F.lit("1.000000,2.000000")), kinds.value("xstr", F.lit("DEAD"), unit=F.lit("hex")), kinds.marker(F.lit(True)), kinds.value("na", F.lit("NA")), F.lit(None)]
    df = None
    for k, c in enumerate(v):
        one = spark.range(1).select(F.lit(str(k)).alias("id"), F.lit("2020-01-01").cast("timestamp").alias("ts"), c.cast(kinds.TAG_VALUE).alias("val"))
        df = one if df is None else df.unionByName(one)
    key = lambda rows: {r.id: None if r.val is None else (r.val.kind, r.val.str, r.val.num, r.val.unit) for r in rows}
    assert key(ts.from_store(ts.to_store(df)).collect()) == key(df.collect())


def test_series_merges(spark):
    s = lambda rows: spark.createDataFrame([(i, at(f"2020-01-{d:02}"), float(v)) for i, d, v in rows], "id string, ts timestamp, val double")
    old, new = s([("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 9)]), s([("a", 2, 20), ("a", 3, 30), ("c", 1, 5)])
    got = lambda df: sorted((r.id, r.ts.day, r.val) for r in df.collect())
    assert got(ts.period_replaced(old, new)) == [("a", 1, 1), ("a", 2, 20), ("a", 3, 30), ("b", 1, 9), ("c", 1, 5)]
    assert got(ts.older_prepended(new, old)) == [("a", 1, 1), ("a", 2, 20), ("a", 3, 30), ("b", 1, 9), ("c", 1, 5)]
    assert got(ts.in_range(old, "2020-01-02", "2020-01-04", version="2020-01-03")) == [("a", 2, 2)]


def test_lake(spark, tmp_path):
    rows = [("p", 2020, 12, 31, "2020-12-31 23:59:59.5", 1.0), ("p", 2021, 1, 1, "2021-01-01 00:00:00.0", 2.0), ("p", 2021, 1, 1, "2021-01-01 00:00:00.0", 2.0), ("p", 2021, 1, 3, "2021-01-03 00:00:00.0", 3.0), ("q", 2021, 1, 1, "2021-01-01 00:00:00.0", 4.0)]
    spark.createDataFrame(rows, "k string, year int, month int, day int, time string, v double").write.partitionBy("k", "year", "month", "day").parquet(f"{tmp_path}/lake")
    spec = {"partition_keys": "k='p'", "date_part_keys": {"year_col": "year", "month_col": "month", "day_col": "day"}, "hs_value_column": {"v": "float"}, "hs_date_column": {"time": "%Y-%m-%d %H:%M:%S"}}
    df = spark.read.parquet(f"{tmp_path}/lake").withColumn("time", F.substring("time", 1, 19))
    df.write.partitionBy("k", "year", "month", "day").parquet(f"{tmp_path}/lake2")
    got = ts.read_lake(spark, f"{tmp_path}/lake2", spec, dt.datetime(2020, 12, 31), dt.datetime(2021, 1, 2))
    assert sorted((r.ts.day, r.val) for r in got.collect()) == [(1, 2.0), (31, 1.0)]
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString()


def test_units_and_zones(spark):
    df = spark.createDataFrame([(212.0, "°F", "°C"), (1.5, "kW", "W"), (100.0, "ft²", "m²"), (1.0, "kW", "°C"), (3.0, "??", "??")], "v double, u string, t string")
    got = [r.converted for r in units.converted(df, "v", "u", "t").orderBy("v").collect()]
    assert got == [None, 1500.0, 3.0, pytest.approx(9.290304), pytest.approx(100.0)]
    same = (("kBTU/h/ft²", "W/m²", 3154.590745), ("m³/h", "gal/min", 4.402867539), ("kWh/ft²", "J/m²", 38750077.5), ("°C/h", "K/s", 1 / 3600), ("btus_per_hour", "W", 0.29307107), ("kW/gal/min", "W/m³/s", 15850323.14), ("t", "short_ton", 1.0), ("MΩ", "ohm", 1e6), ("°F", "Δ°F", None))
    df = spark.createDataFrame([(1.0, a, b, x) for a, b, x in same], "v double, u string, t string, x double")
    for r in units.converted(df, "v", "u", "t").collect():
        assert r.converted == (None if r.x is None else pytest.approx(r.x)), r
    z = tz.with_full_zone(spark.createDataFrame([("New_York",), ("Paris",), ("Europe/Paris",), ("UTC",), ("Nowhere",)], "tz string"), "tz")
    assert {r.tz: r.tz_full for r in z.collect()} == {"New_York": "America/New_York", "Paris": "Europe/Paris", "Europe/Paris": "Europe/Paris", "UTC": "UTC", "Nowhere": None}


def test_priority_levels(spark):
    w = spark.createDataFrame([("p", 8, 1.0, "u", at("2020-01-01T00:00"), 60), ("p", 8, None, "u", at("2020-01-01T00:01"), None), ("p", 10, 3.0, "v", at("2020-01-01T00:00"), None), ("p", 12, 4.0, "v", at("2020-01-01T00:00"), 30)], "id string, level int, val double, who string, at timestamp, duration_s int")
    got = [(r.level, r.val, r.in_force) for r in ts.last_per_level(w, "2020-01-01 00:05:00").collect()]
    assert got == [(10, 3.0, True)]


def test_tag_maps_are_patched_tag_by_tag(spark):
    n = lambda x: kinds.number(F.lit(x))
    tags = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]).cast(kinds.TAGS)
    one = lambda i, t: spark.range(1).select(F.lit("c").alias("customer_id"), F.lit(i).alias("id"), t.alias("tags"))
    start = one("x", tags(("acctbal", n(1.0)), ("dis", kinds.string(F.lit("X"))))).unionByName(one("y", tags(("dis", kinds.string(F.lit("Y"))), ("area", n(2.0))))).unionByName(one("z", tags(("dis", kinds.string(F.lit("Z"))))))
    versions = ver.closed(start.withColumn("start_datetime", F.lit("2020-01-01").cast("timestamp")))
    patch = one("x", tags(("acctbal", n(5.0)))).unionByName(one("y", tags(("dis", kinds.removed())))).unionByName(one("z", tags((diff.GONE, kinds.removed())))).unionByName(one("n", tags(("dis", kinds.string(F.lit("N"))))))
    got = {(r.id, r.start_datetime.year, r.end_datetime.year): {k: v.str for k, v in r.tags.items()} for r in ver.changed(versions, patch, "2021-06-01 00:00:00").collect()}
    assert got == {
        ("x", 2020, 2021): {"acctbal": "1.0", "dis": "X"}, ("x", 2021, 9999): {"acctbal": "5.0", "dis": "X"}, ("y", 2020, 2021): {"dis": "Y", "area": "2.0"}, ("y", 2021, 9999): {"area": "2.0"},
        ("z", 2020, 2021): {"dis": "Z"}, ("n", 2021, 9999): {"dis": "N"},
    }


def test_rows_within_a_tolerance(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v double, w double")
    left = rows(("a", 4.999e-7, 1.0), ("a", 1.0, float("nan")), ("b", 2.0, None), (None, None, None), ("c", 5.0, 1.0), ("c", 5.0, 1.0), ("d", float("inf"), 0.0))
    right = rows(("a", 5.001e-7, 1.0000009), ("a", 1.0000005, float("nan")), ("b", 2.1, None), (None, None, None), ("c", 5.0000001, 1.0), ("d", float("inf"), 5e-7))
    assert sorted((r.k, r.v, r.side) for r in diff.same_rows(left, right).collect()) == [("b", 2.0, "left"), ("b", 2.1, "right"), ("c", 5.0, "left")]


def test_snapshot_times_few_or_many(spark, monkeypatch):
    rows = [("", "a", "2024-01-01", 1), ("", "a", "2024-01-02", 1), ("", "a", "2024-01-04", 1), ("", "b", "2024-01-01", 1), (None, "a", "2024-01-03", 1)]
    df = spark.createDataFrame(rows, "customer_id string, id string, taken string, v int").withColumn("taken", F.col("taken").cast("timestamp"))
    few = sorted(map(str, ver.history(df, F.col("v")).collect()))
    assert len(few) == 3  # a and b of one tenant, whose snapshots lack no a, and a without tenant
    monkeypatch.setattr(ver, "TIMES", 0)
    assert sorted(map(str, ver.history(df, F.col("v")).collect())) == few
    empty = spark.sql("SELECT '' AS customer_id, timestamp'2024-01-05' AS taken")
    last = ver.history(df, F.col("v"), times=df.select("customer_id", "taken").unionByName(empty)).where("id = 'a' AND customer_id = ''").agg(F.max("end_datetime")).first()[0]
    assert str(last) == "2024-01-04 23:59:59.999999"


def test_purge_keeps_rows_without_tenant(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "customer_id string")
    assert {r.customer_id for r in ver.purged(df, "a").collect()} == {"b", None}


def test_places_of_sorted_rows_in_several_parts(spark):
    from tagframe import queries

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many parts as there are ranges
    try:
        rows = queries.QUERIES["series_sources"](spark, "/root/testdata/sf0.01").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    at = {r.event_id: r.ts for r in spark.read.parquet("/root/testdata/sf0.01/events.parquet").collect()}
    newest = sorted(sorted(rows, key=lambda r: at[r.event_id], reverse=True), key=lambda r: (r.id, r.source))
    assert len(rows) == len(at) and [r.place for r in newest] == list(range(len(rows)))
