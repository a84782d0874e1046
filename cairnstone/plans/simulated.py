"""The chunk-store simulation as a query: a scripted trace, and random faults driven by events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.simulation import run_commands
from ..registry import query
from ..sources.tables import table


@query("gfs_trace")
def gfs_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simulation for each user of events: event types become writes, faults, leases, staged and committed mutations, masters that stop and start, and ticks."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k, seq = F.col("event_id"), F.row_number().over(w).cast("long")
    kind = F.col("event_type")
    view = F.element_at(F.array(*[F.lit(x) for x in ("lease", "stage", "commit", "tick", "stop_master", "start_master", "lease", "stage")]), (seq % 8 + 1).cast("int"))
    op = F.when(kind == "signup", "create").when(kind == "purchase", "stop_worker").when(kind == "error", "lose_worker_data").when(kind == "click", F.when(k % 2 == 0, "start_worker").otherwise("tick")).otherwise(view)
    commands = e.select(F.col("user_id").alias("sim"), seq.alias("seq"), k.alias("k"), op.alias("op"))
    op, data = F.col("op"), F.repeat(F.lit("x"), (F.col("k") % 20).cast("int"))
    args = (
        F.when(op == "create", F.format_string('{"path": "/f%d", "data": "%s"}', "k", data))
        .when(op == "lease", F.format_string('{"c": %d}', F.col("k") % 2))
        .when(op == "stage", F.format_string('{"lease": %d, "data": "y"}', F.col("k") % 2))
        .when(op == "commit", F.format_string('{"lease": %d, "mutation": %d, "offset": 0}', F.col("k") % 2, F.col("k") % 3))
        .when(op.isin("stop_master", "start_master"), F.format_string('{"m": %d}', F.col("k") % 2))
        .when(op == "tick", "{}")
        .otherwise(F.format_string('{"w": %d}', F.col("k") % 6))
    )
    return run_commands(commands.select("sim", "seq", "op", args.alias("args")), chunk_size=8)
