import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tagframe.functions import tz
from tagframe.jobs import series, versions


def test_joins_in_buckets_are_those_of_the_range_join(spark):
    """One id has half of all events; its versions are open, short, and of before and after."""
    start = dt.datetime(2021, 1, 1)
    v = [("hot", k, start + dt.timedelta(hours=10 * k), start + dt.timedelta(hours=10 * k + 8)) for k in range(-3, 40)] + [("cold", 0, start, dt.datetime(9999, 12, 31)), ("never", 0, start, start)]
    v = spark.createDataFrame(v, "id string, state int, start_datetime timestamp, end_datetime timestamp")
    e = spark.range(600).select((F.col("id")).alias("n"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 3 == 0, "cold").otherwise("lone").alias("id"), (F.lit(start).cast("timestamp") + F.make_interval(mins=F.col("id").cast("int") * 37)).alias("ts"))
    rows = lambda df: sorted(((r.n, r.id, r.state) for r in df.select("n", "id", "state").collect()), key=str)
    want = rows(versions.at_each_time(e, v))
    for hot in (10_000, 50, 7):
        got = versions.at_each_time_in_buckets(e, v, hot=hot)
        assert rows(got) == want and got.columns == versions.at_each_time(e, v).columns
    assert rows(versions.at_each_time_in_buckets(e.limit(0), v)) == []
    spread = versions.at_each_time_in_buckets(e, v, hot=7).repartition(1).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in spread} == {"hot": 300, "cold": 100, "lone": 200}


@pytest.fixture
def lake(spark, tmp_path):
    rows = [(f"s{k % 3}", f"2021-{1 + k % 3:02d}-{1 + k % 28:02d} 10:00:{k % 60:02d}", float(k), k % 2 == 0, 2021, 1 + k % 3, 1 + k % 28) for k in range(120)]
    df = spark.createDataFrame(rows, "site string, time string, value double, ok boolean, year int, month int, day int")
    for name in ("a", "b"):
        df.write.partitionBy("site", "year", "month", "day").parquet(str(tmp_path / name))
    return tmp_path, df


def test_all_points_of_a_lake_at_once(spark, lake):
    path, df = lake
    days = {"year_col": "year", "month_col": "month", "day_col": "day"}
    rows = [(f"{t}-{s}", str(path / t), {"site": s}, days, {"value": "float"} if t == "a" else {"value": "float", "ok": "bool"}, {"time": "%Y-%m-%d %H:%M:%S"}) for t in "ab" for s in ("s0", "s1")]
    described = spark.createDataFrame(rows, series.LAKE)
    start, end = dt.datetime(2021, 1, 10), dt.datetime(2021, 2, 20)
    out = series.read_lake_all(described, start, end)
    for id_, path_, keys, _, values, times in rows:
        spec = {"partition_keys": f"site='{keys['site']}'", "date_part_keys": days, "hs_value_column": values, "hs_date_column": times}
        one = {(r.ts, r.val if len(values) == 1 else (r.val.value, r.val.ok)) for r in series.read_lake(spark, path_, spec, start, end).collect()}
        mine = {(r.ts, r.val.num if len(values) == 1 else (float(json.loads(r.val.str)["value"][2:]), json.loads(r.val.str)["ok"] == "true")) for r in out.where(F.col("id") == id_).collect()}
        assert one == mine and one, id_
    plan = series.read_lake_all(described.where("id = 'a-s0'"), start, end)._jdf.queryExecution().optimizedPlan().toString()
    assert "month" in plan and series.read_lake_all(described.limit(0), start, end).count() == 0


def test_zones_by_offset(spark):
    rows = [("2021-01-15 00:00:00", -18000), ("2021-07-15 00:00:00", -14400), ("2021-03-14 06:59:59", -18000), ("2021-03-14 07:00:00", -14400), ("2021-07-01 00:00:00", 0), ("2021-07-01 00:00:00", 20700), ("2021-07-01 00:00:00", 61), (None, 3600)]
    df = spark.createDataFrame(rows, "at string, offset int").withColumn("ts", F.col("at").cast("timestamp"))
    out = tz.with_zone_of_offset(df, "ts", "offset").collect()
    found = {(r.at, r.offset): r.tz_short for r in out}
    assert len(out) == len(rows) and found[("2021-07-01 00:00:00", 0)] == "UTC" and found[("2021-07-01 00:00:00", 61)] is None and found[(None, 3600)] is None
    assert found[("2021-07-01 00:00:00", 20700)] in ("Kathmandu", "Katmandu")
    full, names = tz.zones(), list(tz.zones())
    from zoneinfo import ZoneInfo

    for (at, offset), short in found.items():
        if at and short and offset:
            when = dt.datetime.fromisoformat(at).replace(tzinfo=dt.timezone.utc)
            fits = [n for n in names if when.astimezone(ZoneInfo(full[n])).utcoffset().total_seconds() == offset]
            assert short == fits[0], (at, offset)
