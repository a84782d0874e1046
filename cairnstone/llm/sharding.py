"""Two-pass external shuffle into equal shards.

Pass one scatters every record, by a seeded hash of all its columns, into
buckets that fit one task's memory. Pass two applies a seeded Fisher-Yates
shuffle to each bucket and writes it. Bucket after bucket, the written table is
one random permutation of the input; record number p of it goes to shard
p mod n_shards at slot p div n_shards, so that shard sizes differ by one at most.

Nulls are hashed and kept like any value, empty and very long texts are
records like others, repeated rows are kept as often as they come, an empty
table gives an empty result, and other columns travel unchanged (a column named
like one of the operator's own raises ValueError). Rows equal in all columns have
one hash: those that come HOT_ROWS times and more are scattered by their place in
the input instead, so that no bucket gathers them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import BROADCAST_BYTES, load, materialise

OWN = ("shard", "slot")
#: Bytes of a bucket's records, on average.
BUCKET_BYTES = 16 << 20
#: A record that comes so often is scattered copy by copy.
HOT_ROWS = 4096


def record_bytes(text: str = "text") -> F.Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def fisher_yates(n: int, seed: int) -> "np.ndarray":  # noqa: F821
    """A permutation of range(n): position i swaps with a random position from 0 to i, from the last down."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    out = list(range(n))
    for i in range(n - 1, 0, -1):
        j = picks[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def _shuffle_bucket(seed: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        table = pa.Table.from_batches(list(batches))
        bucket = key[0].as_py()
        # Tasks see a bucket's rows in any order; sorting by the record hash makes the shuffle repeatable.
        table = table.take(pc.sort_indices(table, [("_record", "ascending")]))
        order = fisher_yates(table.num_rows, seed * 1_000_003 + bucket)
        table = table.take(pa.array(order)).drop_columns(["_record"])
        table = table.append_column("_at", pa.array(range(table.num_rows), pa.int64()))
        yield from table.to_batches()

    return run


def scatter_and_shuffle(df: DataFrame, seed: int, bucket_bytes: int) -> DataFrame:
    """Both passes. The written table has the records, _bucket and _at (position in the shuffled bucket)."""
    record = F.xxhash64(F.lit(seed), *[df[f"`{c}`"].cast("string") for c in df.columns])
    # All columns travel, so all of them count.
    size = sum((F.coalesce(F.octet_length(df[f"`{c}`"].cast("string")), F.lit(0)).cast("long") + F.lit(8) for c in df.columns), F.lit(0))
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // bucket_bytes))
    parts = max(1, min(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    records = df.withColumn("_record", record)
    hot = materialise(records.groupBy("_record").count().where(F.col("count") >= HOT_ROWS).select(F.col("_record").alias("_hot")), "hot")
    k = hot.count()
    if k:
        hot = F.broadcast(hot) if k * 64 <= BROADCAST_BYTES else hot
        records = records.withColumn("_copy", F.monotonically_increasing_id()).join(hot, F.col("_record") == F.col("_hot"), "left")
        copy = F.when(F.col("_hot").isNotNull(), F.col("_copy")).otherwise(F.lit(0))
    else:
        copy = F.lit(0)
    scattered = records.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_record"), copy), F.lit(n)).cast("long")).drop("_copy", "_hot")
    scattered = scattered.repartition(parts if n <= parts else n, "_bucket")
    schema = scattered.drop("_record").schema.add("_at", "long")
    return materialise(scattered.groupBy("_bucket").applyInArrow(_shuffle_bucket(seed), schema), "shuffled")


def shard(df: DataFrame, n_shards: int = 24, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The records of df with shard (int) and slot (long, gapless from 0 in each shard)."""
    if clash := [c for c in df.columns if c.lower() in {*OWN, "_bucket", "_at", "_record", "_copy", "_hot"}]:
        raise ValueError(f"columns already there: {clash}")
    shuffled = scatter_and_shuffle(df, seed, bucket_bytes)
    sizes = materialise(shuffled.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")), "buckets")
    # One row for each bucket of bucket_bytes: some 62 500 rows a TB.
    from pyspark.sql import Window

    before = F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    if sizes.count() * 16 <= BROADCAST_BYTES:
        starts = F.broadcast(starts)
    p = F.col("_start") + F.col("_at")
    return shuffled.join(starts, "_bucket").select(*[shuffled[f"`{c}`"] for c in df.columns], F.pmod(p, F.lit(n_shards)).cast("int").alias("shard"), F.floor(p / F.lit(n_shards)).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder shard=k for each shard, its files sorted by slot. A shard may span several tasks, cut by slot."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(load(spark, sf_dir, "documents"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return out.select("doc_id", record_bytes().alias("size"), crc.cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
