import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tagframe.functions import kinds
from tagframe.jobs import stored, versions
from tagframe.operators import diff, grid

DAY = dt.datetime(2021, 1, 1)
POINTS = "customer_id string, id string, ts timestamp, val double"


def points(spark, rows):
    return spark.createDataFrame([("", i, DAY + dt.timedelta(hours=h), float(v)) for i, h, v in rows], POINTS)


def there(spark, path):
    return {(r.id, int((r.ts - DAY).total_seconds() // 3600)): r.val for r in stored.read_series(spark, path).collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_writes_touch_their_days_alone_and_repeats_change_nothing(spark, tmp_path):
    path = str(tmp_path / "series")
    stored.create_series(points(spark, [("a", h, h) for h in range(0, 96, 6)] + [("b", 5, 1), ("b", 5, 1)]), path)
    before = files(path)
    batch = points(spark, [("a", 30, 100), ("a", 31, 101), ("c", 26, 1)])
    stored.write_points(batch, path, 1)
    want = {("a", h): float(h) for h in range(0, 96, 6)} | {("b", 5): 1.0, ("a", 30): 100.0, ("a", 31): 101.0, ("c", 26): 1.0}
    assert there(spark, path) == want
    assert {f for f in before if "2021-01-02" not in f} <= files(path)
    stored.write_points(points(spark, [("a", 30, 200)]), path, 2)
    stored.write_points(batch, path, 1)  # late again
    assert there(spark, path) == {**want, ("a", 30): 200.0} and stored.last_batch(spark, path) == 2


def test_periods_are_replaced(spark, tmp_path):
    path = str(tmp_path / "series")
    old = [(i, h, h) for i in "ab" for h in range(0, 120, 5)]
    stored.create_series(points(spark, old), path)
    new = points(spark, [("a", 20, 1), ("a", 100, 2)])
    for _ in range(2):
        stored.replace_period(new, path, 1)
        want = {(i, h): float(v) for i, h, v in old if i == "b" or h < 20 or h > 100} | {("a", 20): 1.0, ("a", 100): 2.0}
        assert there(spark, path) == want
    stored.write_points(points(spark, [("a", 50, 9)]), path, 0)  # an older batch does not bring a deleted point back
    assert there(spark, path) == want


def test_older_points_are_prepended_after_a_write_that_died(spark, tmp_path):
    path = str(tmp_path / "series")
    stored.create_series(points(spark, [("a", 50, 0), ("b", 3, 0)]), path)
    source = points(spark, [("a", h, 1) for h in range(0, 100, 10)] + [("b", 2, 1), ("b", 9, 1), ("c", 7, 1)])
    stored.write_points(points(spark, [("a", 0, 1)]), path, 1)  # what a first attempt left
    stored.prepend_older(source, path, 1)
    assert there(spark, path) == {("a", h): 1.0 for h in range(0, 50, 10)} | {("a", 50): 0.0, ("b", 2): 1.0, ("b", 3): 0.0, ("c", 7): 1.0}


def test_a_stream_that_dies_within_a_batch(spark, tmp_path):
    path, source, checkpoint = str(tmp_path / "series"), str(tmp_path / "in"), str(tmp_path / "checkpoint")
    stored.create_series(points(spark, [("a", 0, 0)]), path)
    for k in range(3):
        points(spark, [("a", h, 10 * k + h) for h in range(k, 60, 7)]).coalesce(1).write.mode("append").parquet(source)
    sink, dies = stored.point_sink(path), [True]

    def fragile(batch, number):
        sink(batch.where("hour(ts) < 12"), number) if number == 1 and dies[0] else sink(batch, number)
        if number == 1 and dies[0]:
            dies[0] = False
            raise RuntimeError("died")

    def start():
        stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(source)
        return stream.writeStream.foreachBatch(fragile).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="died"):
        start().awaitTermination()
    start().awaitTermination()
    order = [{(r.id, int((r.ts - DAY).total_seconds() // 3600)): r.val for r in spark.read.schema(POINTS).parquet(f).collect()} for f in sorted(files(source), key=os.path.getmtime)]
    want = {("a", 0): 0.0}
    for batch in order:
        want |= batch
    assert there(spark, path) == want


NOW = dt.datetime(2020, 1, 1)


def test_patches_fold_like_one_after_the_other(spark, tmp_path):
    rnd = random.Random(4)
    number = lambda x: {"kind": "number", "str": f"{x}.0", "num": float(x), "unit": None, "ts": None, "tz": None, "dis": None}
    gone = {"kind": "remove", "str": "R", "num": None, "unit": None, "ts": None, "tz": None, "dis": None}
    schema = f"customer_id string, id string, start_datetime timestamp, end_datetime timestamp, tags {kinds.TAGS.simpleString()}, note string"
    end = dt.datetime(9999, 12, 31, 23, 59, 59)
    rows = [("", f"e{k}", NOW - dt.timedelta(days=9), NOW - dt.timedelta(days=2, microseconds=1), {"x": number(0)}, "old") for k in range(20)]
    rows += [("", f"e{k}", NOW - dt.timedelta(days=2), end, {"x": number(k), "y": number(1)}, f"n{k}") for k in range(20)]
    table = spark.createDataFrame(rows, schema)
    patches = []
    for p in range(4):
        for k in rnd.sample(range(24), 9):
            tags = {diff.GONE: gone} if rnd.random() < 0.25 else {rnd.choice("xyz"): rnd.choice([number(10 * p + k), gone])}
            patches.append(("", f"e{k}", NOW + dt.timedelta(days=p), tags, rnd.choice([None, f"p{p}"])))
    every = spark.createDataFrame(patches, f"customer_id string, id string, at timestamp, tags {kinds.TAGS.simpleString()}, note string")
    want = table
    for p in range(4):
        at = NOW + dt.timedelta(days=p)
        want = versions.changed(want, every.where(F.col("at") == F.lit(at)).drop("at"), at)
    plain = lambda df: sorted((r.id, r.start_datetime, r.end_datetime, r.note or "", sorted((t, v.num) for t, v in r.tags.items())) for r in df.collect())
    want = plain(want)
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    stored.create_versions(table, one)
    stored.merge_patches(every, one, 1)
    assert plain(stored.read_versions(spark, one)) == want
    stored.create_versions(table, many)
    for p in range(4):
        stored.merge_patches(every.where(F.col("at") == F.lit(NOW + dt.timedelta(days=p))), many, p + 1)
        stored.merge_patches(every.where(F.col("at") == F.lit(NOW + dt.timedelta(days=p))), many, p + 1)
    assert plain(stored.read_versions(spark, many)) == want


def test_merges_leave_other_buckets_alone_and_can_die_between_writes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "versions")
    rows = spark.range(40).select(F.lit("").alias("customer_id"), F.col("id").cast("string").alias("id"), F.lit("2019-01-01").cast("timestamp").alias("start_datetime"), F.lit(versions.END).cast("timestamp").alias("end_datetime"), F.lit("a").alias("v"))
    stored.create_versions(rows, path)
    before = files(path)
    patch = spark.createDataFrame([("", "3", NOW, "b", False), ("", "4", NOW, None, True)], "customer_id string, id string, at timestamp, v string, gone boolean")
    put = stored._put_open
    monkeypatch.setattr(stored, "_put_open", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        stored.merge_patches(patch, path, 1, F.col("gone"))
    monkeypatch.setattr(stored, "_put_open", put)
    for _ in range(2):
        stored.merge_patches(patch, path, 1, F.col("gone"))
    got = stored.read_versions(spark, path)
    assert got.count() == 41 and sorted((r.id, r.v) for r in got.where("end_datetime > '9999-01-01' AND id IN ('3', '4', '5')").collect()) == [("3", "b"), ("5", "a")]
    assert len(before - files(path)) <= 2  # the buckets of the two keys
    lone = rows.where("id = '7'")
    other = str(tmp_path / "lone")
    stored.create_versions(lone, other)
    stored.merge_patches(patch.where("id = '4'").withColumn("id", F.lit("7")), other, 1, F.col("gone"))
    assert [r.end_datetime.year for r in stored.read_versions(spark, other).collect()] == [2019]


def test_tag_tables_merge(spark, tmp_path):
    df = spark.createDataFrame([("", "i", 1.0)], "customer_id string, id string, x double")
    table = grid.to_tags(df.drop("customer_id")).select(F.lit("").alias("customer_id"), "id", F.lit("2019-01-01").cast("timestamp").alias("start_datetime"), F.lit(versions.END).cast("timestamp").alias("end_datetime"), "tags")
    path = str(tmp_path / "tags")
    stored.create_versions(table, path)
    stored.merge_patches(table.select("customer_id", "id", F.lit(NOW).alias("at"), F.create_map(F.lit("y"), kinds.number(F.lit(2.0))).cast(kinds.TAGS).alias("tags")), path, 1)
    first, second = (sorted(r.tags) for r in stored.read_versions(spark, path).orderBy("start_datetime").collect())
    assert "x" in first and second == sorted([*first, "y"])
