"""Structured Streaming: liveness with timers, windowed flow, latest state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream, event time as a timestamp."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def flow_windows(events: DataFrame, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Value a second by type and tumbling window; rows later than the watermark are dropped."""
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", (F.col("v") / seconds).alias("bps"))


def sessions(events: DataFrame, gap: str = "90 minutes", late: str = "1 day") -> DataFrame:
    """Stretches of a user's events without a gap: a gap is a death and a rebirth."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def liveness(events: DataFrame, deadline_s: int = 5400, late: str = "1 minute") -> DataFrame:
    """(user_id, died_at, deaths): a user is dead deadline_s after its last event, told by an event-time timer."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, deaths = state.get if state.exists else (None, 0)
        out = []
        if state.hasTimedOut:
            deaths += 1
            out.append((key[0], pd.Timestamp(last + deadline_s * 1000, unit="ms"), deaths))
            state.update((last, deaths))
        else:
            beats = sorted(int(t.value // 1_000_000) for b in batches for t in b["ts"])
            for t in beats:
                if last is not None and t - last >= deadline_s * 1000:
                    deaths += 1
                    out.append((key[0], pd.Timestamp(last + deadline_s * 1000, unit="ms"), deaths))
                last = max(t, last or t)
            state.update((last, deaths))
            state.setTimeoutTimestamp(max(last + deadline_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "died_at", "deaths"]).astype({"user_id": "int64", "deaths": "int64", "died_at": "datetime64[ns]"})

    keyed = events.select("user_id", "ts").withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id long, died_at timestamp, deaths long", "last long, deaths long", "append", GroupStateTimeout.EventTimeTimeout)


def collected(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
