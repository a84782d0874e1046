"""Quality by nearest-neighbour voting in a latent semantic space.

Texts are TF-IDF vectors of hashed byte 2- and 3-grams with case and
punctuation; document frequencies run over all documents. A bounded, seeded
sample of labelled rows (SAMPLE_ROWS of each class at most) gives the latent
space, by a truncated SVD, and the labelled vectors. Both are broadcast (2 MB).
Every document's cosine with every labelled vector is computed, in blocks; its
NEIGHBOURS nearest vote with weights of their similarity, and the vote is
corrected for how the sample weighs the classes.

A null or empty text has no vector and takes the labelled rows' share of label
1, as does every text if there is nothing to learn from (0.5 then). Repeated
rows give equal rows, texts of any length are read whole, empty tables give empty
results. A null doc_id is kept and scored, and is never labelled. Of neighbours
equally near at the end of the list any may vote. Only text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import features as X, kernels as K
from .shared import load

SAMPLE_ROWS = 1500
LATENT = 64
NEIGHBOURS = 25
SHARPNESS = 4


def truncated_svd(x: np.ndarray, rank: int, seed: int = 5, steps: int = 2) -> np.ndarray:
    """The right singular vectors (columns) by randomised subspace iteration."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32))[0]
    for _ in range(steps):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)


class Model:
    def __init__(self, idf: np.ndarray, basis: np.ndarray, points: np.ndarray, labels: np.ndarray, weights: np.ndarray, base: float):
        self.idf, self.basis, self.points, self.labels, self.weights, self.base = idf, basis, points, labels, weights, base

    def latent(self, count: np.ndarray) -> np.ndarray:
        return unit(X.tfidf(count, self.idf) @ self.basis)

    def score(self, count: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        near = self.latent(count) @ self.points.T
        k = min(neighbours, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(near, at, 1), 1e-6).astype(np.float64) ** SHARPNESS * self.weights[at]
        out = (w * self.labels[at]).sum(1) / w.sum(1)
        return np.where(count.any(1), out, self.base)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, latent: int = LATENT) -> Model | None:
    """labels: doc_id, quality."""
    sample, sizes, _ = X.labelled(labels, "quality", sample_rows)
    if not sizes:
        return None
    idf = X.inverse_frequencies(docs, X.SHAPE)
    rows = X.texts_of(docs, sample)
    y, x = X.vectors(rows, X.SHAPE, idf, "y", "int")
    if not len(y):
        return None
    labels_of = np.array(y, np.float64)
    there = np.bincount(labels_of.astype(int), minlength=2)
    weight = np.array([sizes.get(c, 0) / max(1, there[c]) for c in (0, 1)])
    basis = truncated_svd(x, latent)
    return Model(idf, basis, unit(x @ basis), labels_of, weight[labels_of.astype(int)], sizes.get(1, 0) / sum(sizes.values()))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None if model is None else model.value
        for batch in K.slices(batches, rows=X.ROWS):
            score = np.full(batch.num_rows, 0.5) if m is None else m.score(X.counts(batch.column("text"), X.SHAPE))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(score, 0, 1))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score)."""
    given = None if model is None else docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(given), "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels").where(X.fold(5) != 0))
    out = score(docs, model)
    return out.select("doc_id", (X.fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
