import datetime as dt

from pyspark.sql import functions as F

from cairnstone.streaming import live

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_windows_and_sessions_equal_batch(spark, tmp_path):
    stream = live.read_events(spark, EVENTS)
    got = live.collected(live.flow_windows(stream, "1 hour"), spark, str(tmp_path / "w"))
    batch = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    want = batch.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    end = batch.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    want = want.where(F.col("window.end") <= F.lit(end)).select("window.start", "event_type", "n")
    assert sorted(map(tuple, got.select("start", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))


def test_liveness_counts_gaps(spark, tmp_path):
    got = live.collected(live.liveness(live.read_events(spark, EVENTS)), spark, str(tmp_path / "l"))
    deaths = {r["user_id"]: r["n"] for r in got.groupBy("user_id").agg(F.max("deaths").alias("n")).collect()}
    batch = {}
    for r in spark.read.parquet(EVENTS).orderBy("ts").collect():
        batch.setdefault(r["user_id"], []).append(r["ts"])
    gaps = {u: sum(b - a >= dt.timedelta(seconds=5400) for a, b in zip(t, t[1:])) for u, t in batch.items()}
    assert all(n <= deaths.get(u, 0) <= n + 1 for u, n in gaps.items())
