from pyspark.sql import functions as F

from tagframe.streaming import live


def stream(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")


def run(df, name, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_his_write_drops_repeats(spark, tmp_path):
    schema = "id string, ts timestamp, val double"
    rows = spark.range(20).select(F.lit("p").alias("id"), F.timestamp_seconds(F.col("id") % 10 + 1000).alias("ts"), F.lit(1.0).alias("val")).collect()
    assert run(live.his_write(stream(spark, tmp_path, "w", rows, schema)), "w", tmp_path, "append").count() == 10


def test_watch_gives_changes_of_subscribed_ids(spark, tmp_path):
    schema = "id string, ts timestamp, val double"
    rows = spark.range(30).select(F.concat(F.lit("p"), F.col("id") % 3).alias("id"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("val")).collect()
    subs = spark.createDataFrame([("w1", "p0", 1.0), ("w1", "p1", 1.0), ("w2", "p0", 1.0)], "watch string, id string, lease_s double")
    got = {(r.watch, r.id): r.val for r in run(live.watch(stream(spark, tmp_path, "v", rows, schema), subs), "v", tmp_path, "update").collect()}
    assert got == {("w1", "p0"): 27.0, ("w1", "p1"): 28.0, ("w2", "p0"): 27.0}


def test_point_writes_keep_the_last_of_each_level(spark, tmp_path):
    schema = "id string, level int, val double, who string, at timestamp, duration_s int"
    rows = spark.range(12).select(F.lit("p").alias("id"), (F.col("id") % 3).cast("int").alias("level"), F.col("id").cast("double").alias("val"), F.lit("u").alias("who"), F.timestamp_seconds("id").alias("at"), F.lit(None).cast("int").alias("duration_s")).collect()
    kept = [spark.createDataFrame([], schema)]
    step = live.point_write_batch(lambda: kept[0], lambda df: kept.__setitem__(0, spark.createDataFrame(df.collect(), schema)))
    q = stream(spark, tmp_path, "p", rows, schema).writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/cp-p").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.level: r.val for r in live.point_read(kept[0], "2030-01-01 00:00:00").collect()} == {0: 9.0, 1: 10.0, 2: 11.0}
