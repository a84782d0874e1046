"""Language identification by nearest centroid.

Texts are TF-IDF vectors of hashed byte 2- and 3-grams over letters. Each
language has several centroids, from spherical k-means over a bounded sample of
its training rows (SAMPLE_ROWS in all); document frequencies run over all
training rows. A text takes the language of the centroid of largest cosine. It
is rejected if that cosine is below the centroid's own limit, the REJECT
quantile of its members' cosines less MARGIN.

A null text, or one without a letter, is `und` with score 0 and rejected; so is
every text if there is nothing to learn from. Repeated rows give equal rows,
texts of any length are read whole, empty tables give empty results. A null doc_id
is kept and predicted, its fold that of the empty text. Of centroids equally near
the first by language, then by number, has it. Other columns are never inputs of a
prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import features as X, kernels as K
from .shared import load

SAMPLE_ROWS = 3200
CENTROIDS = 4
REJECT = 0.005
MARGIN = 0.05


def spherical_kmeans(x: np.ndarray, k: int, seed: int, steps: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), 1)]
    while len(centre) < min(k, len(x)):
        far = np.maximum(1 - (x @ centre.T).max(1), 0)
        if far.sum() <= 0:
            break
        centre = np.concatenate((centre, x[rng.choice(len(x), 1, p=far / far.sum())]))
    for _ in range(steps):
        own = (x @ centre.T).argmax(1)
        for c in range(len(centre)):
            if (own == c).any():
                m = x[own == c].mean(0)
                centre[c] = m / max(float(np.linalg.norm(m)), 1e-12)
    return centre


class Model:
    def __init__(self, idf: np.ndarray, languages: list[str], centres: np.ndarray, limits: np.ndarray):
        self.idf, self.languages, self.centres, self.limits = idf, languages, centres, limits


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS, k: int = CENTROIDS) -> Model | None:
    """train: doc_id, text, lang, none of the last two null."""
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return None
    idf = X.inverse_frequencies(train, X.LETTERS)
    each, keep = max(1, sample_rows // len(sizes)), F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & X.share(n, each, "text"))
    langs, x = X.vectors(train.where(keep).select("doc_id", "lang", "text").distinct(), X.LETTERS, idf, "lang", "string")
    langs = np.array(langs, dtype=object)
    names, centres, limits = [], [], []
    for i, lang in enumerate(sorted(set(langs))):
        own = x[(langs == lang) & (x.any(1))]
        if not len(own):
            continue
        c = spherical_kmeans(own, k, i)
        near = own @ c.T
        for j in range(len(c)):
            mine = near[near.argmax(1) == j, j]
            limits.append(float(np.quantile(mine, REJECT)) - MARGIN if len(mine) else 1.0)
        names += [lang] * len(c)
        centres.append(c)
    return Model(idf, names, np.concatenate(centres), np.array(limits)) if names else None


def _predict(model):
    names = ["doc_id", "lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, m = regex.compile(r"\p{L}").search, None if model is None else model.value
        for batch in K.slices(batches, rows=X.ROWS):
            text = batch.column("text")
            has = np.array([bool(t) and letter(t) is not None for t in text.to_pylist()], bool)
            if m is None:
                pred, score, far = ["und"] * len(text), np.zeros(len(text)), np.ones(len(text), bool)
            else:
                near = X.tfidf(X.counts(text, X.LETTERS), m.idf) @ m.centres.T
                at = near.argmax(1)
                score = np.where(has, np.clip(near[np.arange(len(at)), at], 0, 1), 0).astype(np.float64)
                far = ~has | (score < m.limits[at])
                pred = [m.languages[a] if h else "und" for a, h in zip(at, has)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(far)], names)

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected)."""
    given = None if model is None else docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(given), "doc_id long, lang_pred string, score double, rejected boolean")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(docs.where((X.fold(5) != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    out = predict(docs, model)
    return out.select("doc_id", (X.fold(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
