"""Streaming queries: each runs over what the table holds and returns what its sink got."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..registry import query
from ..sources.tables import sql_query, table
from ..streaming import live


def _folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        at = tempfile.mkdtemp(prefix="cairnstone-")
    return f"{at.rstrip('/')}/cairnstone/stream-{uuid.uuid4().hex}"


@query("stream_liveness")
def stream_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = live.read_events(spark, f"{sf_dir}/events.parquet")
    return live.collected(live.liveness(events), spark, _folder(spark))


@query("stream_flow_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL '1 hour', max(ts) - INTERVAL '10 minutes') FROM events) GROUP BY ALL")
def stream_flow_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of flow that the watermark has closed."""
    events = live.read_events(spark, f"{sf_dir}/events.parquet")
    out = live.collected(live.flow_windows(events, "1 hour"), spark, _folder(spark))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '90 minutes' THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '90 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events, in batch."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.sessions(events)
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


sql_query("latest_by_key", "SELECT user_id, max(struct(ts, event_id)).event_id AS event_id FROM events GROUP BY user_id",
          "SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY user_id")
