"""Hashed byte n-gram counts, document frequencies and TF-IDF vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K

DIMS = 4096
#: Texts counted at once: their counts are a dense matrix.
ROWS = 1024
#: For language: letters alone. For quality: letters with case, digits as one, and every other byte itself.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
LETTERS[65:91] = range(97, 123)
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[48:58] = 48
_ORDERS = (2, 3)


def counts(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Texts x DIMS counts of hashed byte n-grams; a text's ends count as spaces, runs of spaces as one."""
    data, offsets = K.texts(column)
    n = len(offsets) - 1
    full = np.empty(len(data) + n + 1, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    full[:] = 32
    full[np.arange(len(data)) + row + 1] = table[data]
    text = np.concatenate((np.repeat(np.arange(n), np.diff(offsets) + 1), [n]))
    keep = np.ones(len(full), bool)
    keep[1:] = (full[1:] != 32) | (full[:-1] != 32) | (text[1:] != text[:-1])
    full, text = full[keep].astype(np.uint32), text[keep]
    out = np.zeros(n * DIMS, np.float32)
    for k in _ORDERS:
        m = len(full) - k + 1
        if m <= 0:
            continue
        code = np.full(m, np.uint32(k))
        for i in range(k):
            code = code * np.uint32(257) + full[i : i + m]
        bins = (code * np.uint32(2654435761)) >> np.uint32(32 - 12)
        # A gram belongs to the text of its first byte; the space before the next text may end it.
        own = (text[:m] < n) & ((text[k - 1 :] == text[:m]) | (full[k - 1 :] == 32) & (text[k - 2 : len(text) - 1] == text[:m]))
        out += np.bincount((text[:m] * DIMS + bins)[own], minlength=n * DIMS).astype(np.float32)
    return out.reshape(n, DIMS)


def tfidf(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows (1 + ln count) * idf of length 1; a row without counts is zero."""
    x = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0).astype(np.float32) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def _frequencies(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMS, np.int64), 0
        for batch in K.slices(batches, rows=ROWS):
            total += (counts(batch.column("text"), table) > 0).sum(0)
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([*range(DIMS), -1]), pa.array([*total.tolist(), rows])], ["bin", "n"])

    return run


def inverse_frequencies(docs: DataFrame, table: np.ndarray) -> np.ndarray:
    """ln((1 + N) / (1 + n)) + 1 of each bin over all of docs (column text)."""
    rows = docs.select("text").mapInArrow(_frequencies(table), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    n, total = np.zeros(DIMS), 0
    for r in rows:  # DIMS + 1 rows
        if r["bin"] < 0:
            total = r["n"]
        else:
            n[r["bin"]] = r["n"]
    return (np.log((1 + total) / (1 + n)) + 1).astype(np.float32)


def _vectors(table: np.ndarray, idf: np.ndarray, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, rows=ROWS):
            x = tfidf(counts(batch.column("text"), table), idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([r.tobytes() for r in x], pa.binary())], [key, "x"])

    return run


def vectors(docs: DataFrame, table: np.ndarray, idf: np.ndarray, key: str, kind: str) -> tuple[list, np.ndarray]:
    """Keys and TF-IDF vectors of a bounded set of rows, in a fixed order."""
    rows = docs.select(key, "text").mapInArrow(_vectors(table, idf, key), f"{key} {kind}, x binary").toPandas()
    x = np.frombuffer(b"".join(rows["x"]), np.float16).reshape(len(rows), DIMS)
    order = sorted(range(len(rows)), key=lambda i: (str(rows[key].iloc[i]), rows["x"].iloc[i]))
    return [rows[key].iloc[i] for i in order], x[order].astype(np.float32)


def fold(parts: int) -> F.Column:
    """crc32(doc_id as text) modulo parts; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(parts))


def share(n: int, most: int, *columns: str) -> F.Column:
    """Keeps about most of n rows, by a hash of doc_id and the given columns; all of them if there are no more."""
    return F.pmod(F.xxhash64(F.lit(97), "doc_id", *columns), F.lit(1_000_000)) < F.lit(1_000_000 if n <= most else int(1_000_000 * most / n))


def texts_of(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(y, text) of the sampled ids, the least text of each: however many rows have one id, it is one row."""
    rows = docs.where("text is not null").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).select("y", "text")


def labelled(labels: DataFrame, column: str, most: int) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """(doc_id, y) of at most about `most` rows of each class, and the classes' sizes, in all and kept. Rows with null id or label don't count; of several labels of one id the largest does."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = keep | ((F.col("y") == y) & share(n, most))
    local = rows.where(keep).toPandas()  # bounded: two classes of about `most` rows
    kept = local["y"].value_counts().to_dict()
    spark = labels.sparkSession
    sample = spark.createDataFrame(list(zip(local["doc_id"].tolist(), local["y"].tolist())), "doc_id long, y int")
    return sample, sizes, kept
