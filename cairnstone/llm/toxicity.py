"""Toxicity by noisy-channel deobfuscation.

A character trigram model of the whole corpus is the source. The channel writes
letters as look-alikes, puts separators between them, and repeats them. Each
obfuscated word is a lattice of what its characters may stand for, and Viterbi
decoding under the source model restores the likeliest word. The restored text
is then scored by a lexicon of words and word beginnings that speak for toxic
rows: a logistic regression over how many distinct words of a text have each,
fitted to a bounded sample of labelled rows (SAMPLE_ROWS of each class at most).

A separator stands for nothing or for a blank, so a restored word begins where its
token does or behind a separator. From each such place a lattice is decoded if its
skeleton (look-alikes merged, separators dropped, repeats collapsed) begins with
that of a lexicon word: no other can restore to one. Look-alikes at a word's edges
may be letters or signs around it: each such reading has its own lattice.

A null or empty text has no features and takes the score of the intercept. With nothing to
learn from, the lexicon is empty. A null doc_id is kept and scored, and is never
labelled. Repeated rows give equal rows, texts are read whole, empty tables give
empty results. Only text is an input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import features as X, kernels as K
from .shared import load, materialise

SAMPLE_ROWS = 6000
#: A feature's least share of toxic rows; its log likelihood ratio against the base rate must exceed ln(features) + EVIDENCE.
LEAST_SHARE = 0.35
EVIDENCE = 3.0
#: Features of the regression, those with most evidence.
LEXICON = 400
RIDGE = 1.0
#: Rows at the base rate that a feature's share starts from.
PRIOR_ROWS = 2.0
PREFIXES = range(4, 8)
#: Words remembered in a task.
TASK_WORDS = 1 << 17
# What a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¢": "c",
}
SEPARATORS = ".-_*~'`·,/\\ "
_CLASS = {"l": "i", "g": "b"}
_MERGE = {**{k: _CLASS.get(v[0], v[0]) for k, v in LOOKALIKES.items()}, **_CLASS, **{s: "" for s in SEPARATORS}}
_SKELETON = str.maketrans(_MERGE)
_REPEAT = re.compile(r"(.)\1+")
_EDGES = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_RUN = re.compile(r"(.)\1*", re.S)
#: Three and more single characters, each alone between blanks.
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")

_SYMBOLS = 28
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = range(1, 27)
_CODE[65:91] = range(1, 27)
_CODE[128:] = 27


def _ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SYMBOLS**3, np.int64)
    for batch in K.slices(batches):
        data, offsets = K.texts(batch.column("text"))
        code = np.zeros(len(data) + 2, np.int64)
        code[2:] = _CODE[data]
        total += np.bincount((code[:-2] * _SYMBOLS + code[1:-1]) * _SYMBOLS + code[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def source_model(docs: DataFrame) -> np.ndarray:
    """ln P(c | a, b) by symbols: 0 for blanks and signs, 1 to 26 letters, 27 other letters. Counts run over all of docs."""
    n = np.zeros(_SYMBOLS**3)
    for r in docs.select("text").mapInArrow(_ngrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        n[r["gram"]] = r["n"]  # 28**3 rows at most
    n = n.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    one = n.sum((0, 1)) + 1
    two = n.sum(0) + 5 * one / one.sum()
    two /= two.sum(1, keepdims=True)
    three = n + 5 * two[None]
    return np.log(three / three.sum(2, keepdims=True))


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, what it may stand for and the channel's ln probability. word is in lower case."""
    out: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", word, re.S):
        c, n = m[1], len(m[0])
        if c in SEPARATORS:
            out.append([("", -0.5), (" ", -1.5)])
            continue
        letters = LOOKALIKES.get(c)
        if letters is None:
            out.append([(c, 0.0)] if n == 1 else [(c, -1.0), (c * 2, -0.2 if n == 2 else -1.0)])
        else:
            out.append([(x * k, -1.0 - (0.7 if k == 2 else 0.0)) for x in letters for k in ((1,) if n == 1 else (1, 2))])
    return out


def viterbi(options: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest reading of a lattice. States are the last two symbols."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for step in [*options, [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (p, text) in best.items():
            for reading, cost in step:
                s, x, y = p + cost, a, b
                for c in reading:
                    z = symbol(c)
                    s += model[x, y, z]
                    x, y = y, z
                if (x, y) not in new or new[x, y] < (s, text + reading):
                    new[x, y] = (s, text + reading)
        best = new
    return max(best.values())[1].strip()


def skeleton(word: str) -> str:
    return _REPEAT.sub(r"\1", word.translate(_SKELETON))


def tokens(text: str) -> tuple[set[str], set[str]]:
    """Distinct words between blanks, and spaced-out stretches; in lower case."""
    text = text.lower()
    return set(text.split()), {m.group() for m in _SPACED.finditer(text)}


def parts(word: str) -> list[str]:
    """A word as features: itself, and its beginnings (with a trailing dash)."""
    return [word, *[word[:n] + "-" for n in PREFIXES if n < len(word)]]


class Reader:
    """Features of the lexicon in a text, as written and as restored."""

    def __init__(self, weights: dict[str, float], base: float, model: np.ndarray):
        self.weights, self.base, self.model = weights, base, model
        self.skeletons = {skeleton(w.rstrip("-")) for w in weights}
        self.lengths = sorted({len(s) for s in self.skeletons})
        self.longest = max(map(len, weights), default=0)
        self.words = sorted({len(w) for w in weights if len(w) > 3 and not w.endswith("-")})
        self.known: dict[str, tuple[str, ...]] = {}

    def _of(self, word: str) -> list[str]:
        return [p for p in parts(word) if p in self.weights]

    def restore(self, word: str) -> str:
        return viterbi(lattice(word), self.model)

    def begun(self, plain: str) -> list[str]:
        """plain from where a lexicon word may begin: whole from its first character, and from behind a separator as far as such a word can reach."""
        most, s, out = max(self.lengths, default=0), "", []
        for i in range(len(plain) - 1, -1, -1):
            c = skeleton(plain[i])
            s = s if s.startswith(c) else (c + s)[:most]
            if (not i or plain[i - 1] in SEPARATORS) and plain[i] not in SEPARATORS and any(s[:n] in self.skeletons for n in self.lengths):
                letters, end = 0, len(plain)
                for m in _RUN.finditer(plain, i):
                    letters += m[1] not in SEPARATORS
                    if i and letters > self.longest:
                        end = m.end()
                        break
                out.append(plain[i:end])
        return out[::-1]

    def edged(self, token: str, plain: str) -> list[str]:
        """The token with look-alikes left at its edges, in every way that may hold a lexicon word."""
        runs = [(m.start(), m.end()) for m in _RUN.finditer(token)]
        a = token.index(plain) if plain else len(token)
        b = a + len(plain) if plain else 0
        # A run stands for a letter at least: with more of them behind it no word is in the lexicon.
        ends = [b, *[j for i, j in runs if i >= b and token[i] in LOOKALIKES][: self.longest]]
        most = max(self.lengths, default=0)
        s = skeleton(token[a:])[:most]
        starts = [(a, s)]
        for i, _ in reversed([r for r in runs if r[1] <= a]):
            c = skeleton(token[i])
            s = s if s.startswith(c) else (c + s)[:most]
            if token[i] in LOOKALIKES:
                starts.append((i, s))
        starts = [i for i, s in starts if any(s[:n] in self.skeletons for n in self.lengths)]
        return [token[i:j] for i in starts for j in ends if i < j and (i, j) != (a, b)]

    def features(self, token: str) -> tuple[str, ...]:
        got = self.known.get(token)
        if got is None:
            plain = _EDGES.sub("", token)
            found = self._of(plain)
            if not plain.isalpha() or _REPEAT.search(plain):
                for part in self.begun(plain):
                    for word in self.restore(part).split():
                        found += self._of(word)
            if len(plain) < len(token):
                for part in self.edged(token, plain):
                    for word in self.restore(part).split():
                        found += self._of(word)
            if len(self.known) > TASK_WORDS:
                self.known.clear()
            got = self.known[token] = tuple(dict.fromkeys(found))
        return got

    def spaced(self, stretch: str) -> list[str]:
        s = skeleton(stretch)
        if not any(s[i : i + n] in self.skeletons for n in self.lengths for i in range(len(s) - n + 1)):
            return []
        read = self.restore(re.sub(r"\s+", " ", stretch))
        whole = read.replace(" ", "")
        # Blanks between words can't be told from blanks inside them: lexicon words count wherever they stand.
        at = [whole[i : i + n] for n in self.words for i in range(len(whole) - n + 1)]
        return [f for word in read.split() for f in self._of(word)] + [w for w in at if w in self.weights]

    def count(self, text: str | None) -> Counter:
        """How many distinct words of the text have each feature of the lexicon."""
        found: Counter = Counter()
        if text:
            words, stretches = tokens(text)
            for w in words:
                got = self.known.get(w)
                if got is None:
                    got = self.features(w)
                if got:
                    found.update(got)
            for s in stretches:
                found.update(self.spaced(s))
        return found

    def score(self, text: str | None) -> float:
        x = self.base + sum(self.weights[f] * math.log1p(n) for f, n in self.count(text).items())
        return 1 / (1 + math.exp(-min(max(x, -50), 50)))


def regress(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the intercept, which isn't shrunk."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - shrink * beta
        curve = (x.T * (w * p * (1 - p))) @ x + np.diag(shrink)
        step = np.linalg.solve(curve, gradient)
        beta += step
        if np.abs(step).max() < 1e-4:
            break
    return beta


def _sample_counts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        reader = Reader(m.weights, m.base, m.source)
        for batch in K.slices(batches):
            found = [reader.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))], ["y", "feature", "n"])

    return run


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["feature", "y", "n"])

    for batch in K.slices(batches):
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
            words = {_EDGES.sub("", w) for w in tokens(text)[0]}
            for f in {p for w in words if w for p in parts(w)}:
                counts[f, y] += 1
        if len(counts) > TASK_WORDS:
            yield flush()
            counts.clear()
    if counts:
        yield flush()


class Model:
    def __init__(self, weights: dict[str, float], base: float, source: np.ndarray):
        self.weights, self.base, self.source = weights, base, source


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """labels: doc_id, toxic."""
    source = source_model(docs)
    sample, sizes, kept = X.labelled(labels, "toxic", sample_rows)
    if not sizes.get(1) or not kept.get(1):
        return Model({}, -4.0, source)
    up = {y: sizes[y] / kept[y] for y in kept}
    rows = X.texts_of(docs, sample)
    found = rows.mapInArrow(_sample_features, "feature string, y int, n long")
    n = [F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)) for y in (0, 1)]
    found = materialise(found.groupBy("feature").agg(n[0].alias("n0"), n[1].alias("n1")), "features")
    rate, here = sizes[1] / sum(sizes.values()), kept[1] / sum(kept.values())
    share = (F.col("n1") * up[1] + rate * PRIOR_ROWS) / (F.col("n0") * up.get(0, 1.0) + F.col("n1") * up[1] + PRIOR_ROWS)
    part = F.col("n1") / (F.col("n0") + F.col("n1"))
    ratio = F.col("n1") * F.log(part / here) + F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - part) / max(1 - here, 1e-9))).otherwise(F.lit(0.0))
    enough = math.log(found.count() + 1) + EVIDENCE
    lexicon = found.where((F.col("n1") > 0) & (part > here) & (share >= LEAST_SHARE)).where(ratio >= enough).orderBy(F.desc(ratio), "feature").limit(LEXICON).select("feature").toPandas()["feature"].tolist()
    model = Model(dict.fromkeys(lexicon, 0.0), 0.0, source)
    counted = rows.mapInArrow(_sample_counts(docs.sparkSession.sparkContext.broadcast(model)), "y int, feature array<string>, n array<long>").toPandas()
    at, x = {f: i for i, f in enumerate(lexicon)}, np.zeros((len(counted), len(lexicon)))
    for i, (features, n) in enumerate(zip(counted["feature"], counted["n"])):
        for f, k in zip(features, n):
            x[i, at[f]] = math.log1p(k)
    y = counted["y"].to_numpy(np.float64)
    beta = regress(x, y, np.where(y == 1, up[1], up.get(0, 1.0))) if len(y) else np.array([-4.0])
    return Model(dict(zip(lexicon, beta.tolist())), float(beta[-1]), source)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        reader = Reader(m.weights, m.base, m.source)
        for batch in K.slices(batches):
            score = [reader.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def keep_below(model, threshold: float | None = None):
    """For mapInArrow: the rows whose text scores below the threshold, with all their columns."""
    limit = THRESHOLD if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        reader = Reader(m.weights, m.base, m.source)
        for batch in K.slices(batches):
            yield batch.filter(pa.array([reader.score(t) < limit for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score)."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(given), "doc_id long, score double")


THRESHOLD = 0.3


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels").where(X.fold(4) != 2))
    return score(docs, model).select("doc_id", (X.fold(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
