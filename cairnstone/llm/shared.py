"""Session helpers: the shared folder, materialised tables, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship

#: Largest number of bytes that an operator hands to a Python broadcast.
BROADCAST_BYTES = 64 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext.getCheckpointDir()
        if not own and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not own:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairnstone-"))
            own = spark.sparkContext.getCheckpointDir()
        at = own
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairnstone/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialise, dealt into files by key: a later group-by or join on key reads it without a shuffle.

    The catalogue knows the table only while it is opened; its files stay in the shared folder."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", shared_path(spark, name)).bucketBy(parts, key).saveAsTable(table)
    try:
        out = spark.table(table)
        out.schema  # noqa: B018  resolves the table
        return out
    finally:
        spark.sql(f"DROP TABLE {table}")


def shrink(spark: SparkSession) -> None:
    """Lets the executors give heap back that they no longer use: it grows with each step's garbage, up to its limit, and
    Python workers of later steps need memory beside it. One short task for each core."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def bitmap(keys: DataFrame, column: str, bits_log2: int) -> bytes:
    """A bit for each pmod(key, 2**bits_log2). The driver receives at most 2**bits_log2 / 64 longs, whatever the input, in
    Arrow batches: as Python rows the 4 M longs of the largest filter would not fit a small driver."""
    import numpy as np

    bit = F.pmod(F.col(column), F.lit(1 << bits_log2))
    words = keys.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (bits_log2 - 6), np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("w").to_numpy()] = batch.column("b").to_numpy()
    return out.tobytes()


def bits_for(rows: int) -> int:
    """Bits (log2) of a filter of so many rows: 16 for each or more, 2**28 (32 MB) at most; a full filter only lets more pass."""
    return min(28, max(16, (16 * rows).bit_length()))
