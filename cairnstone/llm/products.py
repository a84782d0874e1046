"""Exact top-k inner products by norm-bucketed retrieval.

Components become integers floor(scale * x). Vectors are sorted by length into
buckets; a query meets the bucket of the longest vectors first, which gives it a
lower bound of its k-th score. Other buckets that are too short to reach the
bound never meet it. In each bucket left, the bound over the lengths is a local
cosine threshold: where it is high, only vectors whose focus coordinate (the
query's largest) lies in the feasible interval are verified; where it is low,
only the prefix of vectors long enough. Verification is an integer product.

Queries travel to buckets in blocks, buckets are cut at BUCKET_ROWS rows, and a
task holds one bucket and at most TASK_QUERIES queries.

Rows with a null vector, or null or non-finite components, take no part; nor do
rows with a null id, which could not be named. Every other row is a candidate of
every query but itself: repeated rows, and rows of one id, are rows of their own,
and each of them that is a query has its own ranking. Integers beyond the range
of a long, components and scores, count as the nearest long. Vectors meet only
vectors of their dimension. Ties go to the smaller id; with fewer than k candidates
all are returned; empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import load, materialise

BUCKET_ROWS = 8192
BLOCK_QUERIES = 512
TASK_QUERIES = 1 << 15
#: From this local cosine threshold on, a query prunes by coordinate instead of length.
COORDINATE = 0.7
_PACKED = "block long, dim int, n int, uids binary, ids binary, matrix binary, norms binary, bounds binary, longest double, need double"
_MOST = 2.0**63


def _integers(scale: float):
    names = ["uid", "vec_id", "v", "norm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            id, v = batch.column("vec_id"), batch.column("v")
            keep = pc.and_(id.is_valid(), v.is_valid())
            id, v = id.filter(keep), v.filter(keep)
            if not len(v):
                continue
            lengths = v.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(v)), lengths)
            flat = v.flatten()
            whole = flat.is_valid().to_numpy(zero_copy_only=False)
            x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            finite = whole & np.isfinite(x)
            good = np.bincount(row, ~finite, len(v)) == 0
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(np.where(finite, x, 0) * scale), -_MOST, _MOST)
            norm = np.sqrt(np.bincount(row, x * x, len(v)))[good]
            whole_number = x.astype(np.int64)
            whole_number[x >= _MOST] = np.iinfo(np.int64).max
            whole_number = whole_number[good[row]]
            ends = np.concatenate(([0], np.cumsum(lengths[good]))).astype(np.int64) * 8
            packed = pa.Array.from_buffers(pa.large_binary(), int(good.sum()), [None, pa.py_buffer(ends), pa.py_buffer(whole_number)]).cast(pa.binary())
            uid = number + np.arange(good.sum())
            number += len(uid)
            yield pa.RecordBatch.from_arrays([pa.array(uid), id.filter(pa.array(good)), packed, pa.array(norm)], names)

    return run


def _pack(rows: int):
    """Sorted rows of a partition as matrices of at most `rows` rows of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def packed():
            nonlocal number
            uids, ids, vs, norms, bounds = ([r[i] for r in held] for i in range(5))
            norm, bound = np.array(norms), np.array(bounds)
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(bound > 0, bound / norm, 0.0)
            number += 1
            row = [number, len(vs[0]) // 8, len(ids), np.array(uids, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), b"".join(vs), norm.tobytes(), bound.tobytes(), float(norm.max()), float(need.min())]
            names = [c.split()[0] for c in _PACKED.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("uid", "vec_id", "v", "norm", "bound")]):
                if held and (len(held) == rows or len(held[0][2]) != len(r[2])):
                    yield packed()
                    held = []
                held.append(r)
        if held:
            yield packed()

    return run


def products(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """q @ b.T, exact: by floating point where every partial sum is below 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(b).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ b.T
    out = q.astype(object) @ b.astype(object).T
    return np.clip(out, -(2**63), 2**63 - 1).astype(np.int64)


def feasible(f: float, cosine: float) -> tuple[float, float]:
    """Where a unit vector's coordinate lies if its cosine with a unit vector of coordinate f there is `cosine` or more."""
    a, b = np.arccos(np.clip(f, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(min(np.pi, a + b)) - 1e-9, np.cos(max(0.0, a - b)) + 1e-9


def _best(scores: np.ndarray, uids: np.ndarray, ids: np.ndarray, own: int, bound: float, k: int) -> np.ndarray:
    keep = np.flatnonzero((uids != own) & (scores >= bound))
    if len(keep) > k:
        least = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= least]
    return keep[np.lexsort((ids[keep], ~scores[keep]))][:k]


def search(uids: np.ndarray, ids: np.ndarray, b: np.ndarray, norms: np.ndarray, quids: np.ndarray, q: np.ndarray, qnorms: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, ids and scores of its best in this bucket. norms descend."""
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(bounds > 0, bounds / (qnorms * norms[0]), -np.inf)
        unit = np.where(norms[:, None] > 0, b / norms[:, None], 0.0)
    order: dict[int, np.ndarray] = {}
    by_length = np.flatnonzero(cosine < COORDINATE)
    for i in np.flatnonzero((cosine >= COORDINATE) & (cosine <= 1 + 1e-9)):
        f = int(np.abs(q[i]).argmax())
        if f not in order:
            order[f] = np.argsort(unit[:, f], kind="stable")
        low, high = feasible(q[i, f] / qnorms[i], float(cosine[i]))
        x = unit[order[f], f]
        rows = order[f][np.searchsorted(x, low, "left") : np.searchsorted(x, high, "right")]
        if len(rows):
            scores = products(q[i : i + 1], b[rows])[0]
            at = _best(scores, uids[rows], ids[rows], quids[i], bounds[i], k)
            yield int(i), ids[rows][at], scores[at]
    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(bounds[by_length] > 0, bounds[by_length] / qnorms[by_length], 0.0) * (1 - 1e-12)
        prefix = np.searchsorted(-norms, -least, "right")
        for n in np.unique(prefix):
            group = by_length[prefix == n]
            if not n:
                continue
            scores = products(q[group], b[:n])
            for i, s in zip(group, scores):
                at = _best(s, uids[:n], ids[:n], quids[i], bounds[i], k)
                yield int(i), ids[at], s[at]


def _matrix(row: dict) -> tuple[np.ndarray, ...]:
    uids, ids = np.frombuffer(row["uids"], "<i8"), np.frombuffer(row["ids"], "<i8")
    return uids, ids, np.frombuffer(row["matrix"], "<i8").reshape(row["n"], row["dim"]), np.frombuffer(row["norms"]), np.frombuffer(row["bounds"])


_FOUND = "query long, query_id long, vec_id long, score long"


def _meet(k: int):
    def run(buckets: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        for bucket in buckets.to_pylist():
            uids, ids, b, norms, _ = _matrix(bucket)
            for at in range(queries.num_rows):
                quids, qids, q, qnorms, bounds = _matrix(queries.slice(at, 1).to_pylist()[0])
                for i, found, scores in search(uids, ids, b, norms, quids, q, qnorms, bounds, k):
                    for column, x in zip(out, (np.full(len(found), quids[i]), np.full(len(found), qids[i]), found, scores)):
                        column.append(x)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def top_products(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = 1024, id: str = "vec_id", vector: str = "embedding", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row whose id is divisible by `every`, against all other rows."""
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = materialise(rows.mapInArrow(_integers(scale), "uid long, vec_id long, v binary, norm double"), "vectors")
    n = max(1, -(-rows.count() // bucket_rows))
    dim = F.octet_length("v")
    # A hash splits vectors of one length.
    sorted_rows = rows.withColumn("bound", F.lit(float("-inf"))).repartitionByRange(n, dim, F.desc("norm"), F.xxhash64("uid")).sortWithinPartitions(dim, F.desc("norm"), F.xxhash64("uid"))
    buckets = materialise(sorted_rows.mapInArrow(_pack(bucket_rows), _PACKED), "vector_buckets")
    heads = buckets.groupBy("dim").agg(F.max_by("block", F.struct("longest", -F.col("block"))).alias("head"))
    asked = rows.where(F.col("vec_id") % every == 0)

    def blocks(queries: DataFrame) -> DataFrame:
        parts = max(1, min(n, 64))
        return materialise(queries.repartition(parts, F.xxhash64("uid")).sortWithinPartitions(dim, F.desc("norm"), "uid").mapInArrow(_pack(BLOCK_QUERIES), _PACKED), "query_blocks")

    def meet(queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """pairs: (bucket, block). Queries go to buckets; beyond TASK_QUERIES of them a bucket has several tasks."""
        chunk = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-asked_rows // TASK_QUERIES))))
        sent = pairs.join(queries, "block").withColumn("chunk", chunk)
        tasks = sent.select(F.col("bucket").alias("to"), F.col("chunk").alias("part")).distinct()
        there = buckets.join(tasks, F.col("block") == F.col("to"))
        return there.groupBy("to", "part").cogroup(sent.groupBy("bucket", "chunk")).applyInArrow(_meet(k), _FOUND)

    asked_rows = asked.count()
    first = blocks(asked.withColumn("bound", F.lit(float("-inf"))))
    seen = materialise(meet(first, first.select("block", "dim").join(heads, "dim").select(F.col("head").alias("bucket"), "block")), "first")
    kth = seen.groupBy("query").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("low")).where(F.col("c") >= k)
    second = blocks(asked.join(kth, asked["uid"] == kth["query"], "left").select("uid", "vec_id", "v", "norm", F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))).alias("bound")))
    others = buckets.select("dim", F.col("block").alias("bucket"), "longest").join(heads, "dim").where(F.col("bucket") != F.col("head"))
    pairs = second.select("block", "dim", "need").join(others, "dim").where(F.col("longest") >= F.col("need") * (1 - 1e-12)).select("bucket", "block")
    found = seen.unionByName(meet(second, pairs))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(load(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
