import random

import pandas as pd
from pyspark.sql import functions as F

from tagframe.streaming import state

WRITES = "id string, level int, val double, who string, at timestamp, duration_s int"


def batches(spark, path, name, schema, *rows):
    """Files that a stream reads one after the other."""
    for r in rows:
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}")


def ran(df, path, name):
    store = lambda batch, n: batch.write.mode("append").parquet(f"{path}/{name}-out")
    q = df.writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", f"{path}/{name}-cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}-out").collect()


def at(spark, second):
    import datetime as dt

    return dt.datetime(2021, 1, 1) + dt.timedelta(seconds=second)


def plain_levels(writes):
    """(at, level, val) of every change in force, by looking at all writes at every time that matters."""
    times = sorted({(w[2], 0) for w in writes} | {(w[2] + w[3], 1) for w in writes if w[3] is not None and w[1] is not None})
    out, before = [], (None, None)
    for t, ended in times:
        last = {}
        for level, val, s, d in writes:
            if s <= t and (level not in last or last[level][1] <= s):
                last[level] = (val, s, d)
        held = {k: v for k, (v, s, d) in last.items() if v is not None and (d is None or (s + d > t if ended else s + d >= t))}
        now = (min(held), held[min(held)]) if held else (None, None)
        if now != before:
            out.append((t, *now))
        before = now
    return out


def test_levels_against_all_writes_at_every_time():
    rnd = random.Random(2)
    for _ in range(60):
        seconds = rnd.sample(range(200), 25)
        writes = [(rnd.randint(1, 5), rnd.choice([None, 1.0, 2.0]), s, rnd.choice([None, None, 7, 30])) for s in sorted(seconds)]
        levels, got = state.Levels(), []
        for level, val, s, d in writes:
            got += levels.write(s * 10**6, [(level, val, "u", d)])
        got += levels.until(10**12, included=True)
        assert [(t // 10**6, level, val) for t, level, val, _ in got] == plain_levels(writes)


def test_priority_arrays_over_batches(spark, tmp_path):
    write = lambda s, level, val, d=None: ("p", level, val, f"u{level}", at(spark, s), d)
    first = [write(0, 17, 1.0), write(5, 8, 2.0, 10), write(6, 10, 3.0)]
    second = [write(30, 1, 9.0, 100), ("q", 3, 5.0, None, at(spark, 31), None)]
    third = [write(40, 1, None), write(41, 10, None), ("q", 3, 6.0, None, at(spark, 200), None)]
    got = ran(state.priority_arrays(batches(spark, str(tmp_path), "w", WRITES, first, second, third)), str(tmp_path), "w")
    seconds = lambda r: int((r.at - at(spark, 0)).total_seconds())
    assert sorted((seconds(r), r.level, r.val, r.who) for r in got if r.id == "p") == [(0, 17, 1.0, "u17"), (5, 8, 2.0, "u8"), (15, 10, 3.0, "u10"), (30, 1, 9.0, "u1"), (40, 10, 3.0, "u10"), (41, 17, 1.0, "u17")]
    assert [(seconds(r), r.val) for r in sorted((r for r in got if r.id == "q"), key=seconds)] == [(31, 5.0), (200, 6.0)]


def test_a_duration_ends_without_a_new_write(spark, tmp_path):
    first = [("p", 17, 1.0, "a", at(spark, 0), None), ("p", 8, 2.0, "b", at(spark, 1), 10)]
    second = [("other", 17, 0.0, "c", at(spark, 100), None)]  # only the time goes on
    got = ran(state.priority_arrays(batches(spark, str(tmp_path), "w", WRITES, first, second)), str(tmp_path), "w")
    assert sorted((int((r.at - at(spark, 0)).total_seconds()), r.level, r.val) for r in got if r.id == "p") == [(0, 17, 1.0), (1, 8, 2.0), (11, 17, 1.0)]


def test_watches_subscribe_refresh_expire_and_unsubscribe(spark, tmp_path):
    path = str(tmp_path)
    points = batches(spark, path, "p", "id string, ts timestamp, val double", [("x", at(spark, 0), 1.0), ("x", at(spark, 12), 1.0), ("x", at(spark, 14), 2.0)], [("x", at(spark, 45), 3.0), ("y", at(spark, 46), 1.0)], [("x", at(spark, 300), 4.0), ("y", at(spark, 301), 2.0)])
    event = lambda s, kind, watch, lease=None, i="x": (i, at(spark, s), kind, watch, lease)
    events = batches(spark, path, "e", "id string, at timestamp, kind string, watch string, lease_s double", [event(10, "sub", "w1", 30.0), event(11, "sub", "w2", 1000.0), event(16, "refresh", "w1")], [event(40, "poll", "w1"), event(41, "unsub", "w2"), event(42, "sub", "w3", 10.0, "y")], [event(299, "refresh", "w1")])
    got = ran(state.watches(points, events), path, "g")
    rows = sorted((r.watch, r.id, int((r.ts - at(spark, 0)).total_seconds()), r.val, r.reason) for r in got)
    assert rows == [("w1", "x", 0, 1.0, "sub"), ("w1", "x", 14, 2.0, "change"), ("w1", "x", 14, 2.0, "refresh"), ("w1", "x", 45, 3.0, "change"), ("w2", "x", 0, 1.0, "sub"), ("w2", "x", 14, 2.0, "change"), ("w3", "y", 46, 1.0, "change")]


def test_a_bucket_keeps_its_keys_as_one_value_with_one_timer():
    class Held:
        value, updates = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value, self.updates = value, self.updates + 1

    class Handle:
        timers = []

        def getValueState(self, *_):
            return held

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 10_000

        getExpiryTimeInMs = getCurrentWatermarkInMs

    held, array = Held(), state._PriorityArrays()
    array.init(Handle())
    rows = pd.DataFrame([(f"p{k}", k * 1000, 0, 5, float(k), "u", 1 + k % 3) for k in range(100)], columns=["id", "at_us", "seq", "level", "val", "who", "duration_s"])
    out = pd.concat(array.handleInputRows((0,), iter([rows[50:], rows[:50]]), Now()))
    assert sorted(out["id"]) == sorted(rows["id"]) and (held.updates, Handle.timers) == (1, [1000])
    ended = pd.concat(array.handleExpiredTimer((0,), Now(), Now()))
    assert len(ended) == 100 and ended["level"].isna().all() and (held.updates, Handle.timers) == (2, [1000])


def test_batches_of_a_stream_are_made_by_all_tasks(spark, tmp_path):
    from tagframe import queries

    days = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") % 8 * 86400)
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), days.alias("ts")).repartition(4)
    files = lambda: spark.read.parquet(f"{tmp_path}/points").groupBy(F.input_file_name()).count().collect()
    for k, feed in enumerate(queries._dealt(f"{tmp_path}/points", rows, "ts", rows), 1):
        feed()
        assert sum(r["count"] for r in files()) == 1000 * k and len(files()) > k
