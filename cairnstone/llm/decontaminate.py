"""Benchmark decontamination by CGK embeddings, bit sampling and exact edit verification.

Texts and items are lower-cased and cut into words of letters and digits. A
document is contaminated by an item of n words if some stretch of it is within
word edit distance floor(max_rate * n) of the item.

A CGK walk writes a sequence word by word and goes on to the next word, or stays,
by a random bit of the word and the step: two sequences of small edit distance
become two of small Hamming distance. Every item is embedded by REPETITIONS
walks from its first word on and as many from its last one back, and so is every
window of the item's length in a document; each walk samples SAMPLE coordinates,
and windows that agree with an item in them are candidates. Exact edit distance on the stretch around each decides. Unedited
leaks always agree. An edited one is missed if it agrees under none of the walks:
tests hold every length and number of edits against brute force.

Windows that can hold no leak are not embedded: k edits leave n - 1 - 2k pairs of
neighbouring words of an item together, so a window with fewer pairs of items of
its length is ruled out, and nothing is lost.

The items are broadcast in blocks of bounded bytes, one pass for each block, so a
benchmark of any size works. Items of under min_words words are too short to
tell a leak from chance and match nothing. Null and empty texts and items match
nothing; texts of any length are searched whole; repeated rows and items give
repeated pairs once each; a null doc_id is kept; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .shared import load

MAX_RATE = 0.2
MIN_WORDS = 8
#: Bytes of item text in one broadcast.
BLOCK_BYTES = 4 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Walks of each item and window in either direction, and the coordinates that each of them samples.
REPETITIONS = 16
SAMPLE = 2
#: Windows embedded, and bytes of text searched, at once.
WINDOWS = 1 << 12
SLICE_BYTES = 4 << 20
#: Stands behind a sequence's end.
_END = K.U(0x5851F42D4C957F2D)
#: Before any start: an item whose first words are cut may start before word 0 of a slice.
_NOTHING = -(1 << 62)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the first word of each text, read a part at a time: hashing takes tens of bytes of memory for each byte."""
    hashes, first, total = [np.zeros(0, K.U)], [np.zeros(1, np.int64)], 0
    for part in K.cut(pa.RecordBatch.from_arrays([column], ["text"])):
        data, offsets = K.texts(pc.utf8_lower(part.column("text").cast(pa.large_string())))
        starts, ends, at = K.spans(data, offsets, _WORD)
        hashes.append(K.hashes(data, starts, ends))
        first.append(at[1:] + total)
        total += len(starts)
    return np.concatenate(hashes), np.concatenate(first)


def shared(distinct: np.ndarray, counts: np.ndarray, part: np.ndarray) -> int:
    """How many words of an item (its distinct words, sorted, and their counts) stand in part."""
    at = np.minimum(np.searchsorted(distinct, part), len(distinct) - 1)
    there = np.zeros(len(distinct), bool)
    there[at[distinct[at] == part]] = True
    return int(counts[there].sum())


def fit(item: np.ndarray, part: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the stretch of part nearest to item, if within `most` edits."""

    def ends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        step = np.arange(len(y) + 1)
        row = np.zeros(len(y) + 1, np.int64)
        for i, word in enumerate(x, 1):
            new = np.empty_like(row)
            new[0] = i
            new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != word))
            row = np.minimum.accumulate(new - step) + step
        return row

    row = ends(item, part)
    end = int(row.argmin())
    if row[end] > most:
        return None
    back = ends(item[::-1], part[:end][::-1])
    return int(row[end]), end - int(back.argmin()), end


class Walks:
    """The walks over windows of n words: a multiplier for each step, whose top bit of the product moves on, and the sampled steps."""

    def __init__(self, n: int, back: bool):
        rng = np.random.Generator(np.random.PCG64(2 * n + back))
        steps = 2 * n  # a walk passes a word in two steps on average
        self.n = n
        self.move = rng.integers(0, 1 << 63, (REPETITIONS, steps), dtype=np.uint64) * K.U(2) + K.U(1)
        self.picked = np.zeros((REPETITIONS, steps), bool)
        for r in self.picked:
            r[rng.choice(steps, min(SAMPLE, steps), replace=False)] = True
        self.steps = int(np.flatnonzero(self.picked.any(0)).max()) + 1

    def keys(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A key for each walk and window; start, end: of the windows in h, at most n words apart."""
        at = np.repeat(start[None], REPETITIONS, 0)
        key = np.repeat(np.arange(REPETITIONS, dtype=np.uint64)[:, None], len(start), 1)
        last = len(h) - 1
        for j in range(self.steps):
            word = np.where(at < end, h[np.minimum(at, last)], _END)
            p = self.picked[:, j]
            if p.any():
                key[p] = K.mix(key[p] * K.U(3) + word[p], 23)
            at += ((word * self.move[:, j : j + 1]) >> K.U(63)).astype(at.dtype)
        return key


def _bigrams(h: np.ndarray) -> np.ndarray:
    return K.grams(h, 2, 29)


class Items:
    """Items by length, with their keys under all walks, and the pairs of neighbouring words of all of them."""

    def __init__(self, ids: list[int], texts: list[str], max_rate: float, min_words: int):
        h, first = words(pa.array(texts, pa.string()))
        spans = [(i, a, b) for i, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist()) if b - a >= max(1, min_words)]
        self.ids = [i for i, _, _ in spans]
        self.words = [h[a:b] for _, a, b in spans]
        self.distinct = [np.unique(w, return_counts=True) for w in self.words]
        self.most = [int(max_rate * len(w) + 1e-9) for w in self.words]
        of: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            of.setdefault(len(w), []).append(k)
        self.walks, self.keys, self.item, self.table = {}, {}, {}, {}
        for n, own in of.items():
            for back in (False, True):
                walks = self.walks[n, back] = Walks(n, back)
                flat, start = np.concatenate([self.words[k][:: -1 if back else 1] for k in own]), np.arange(len(own)) * n
                key = np.concatenate([walks.keys(flat, start[i : i + WINDOWS], start[i : i + WINDOWS] + n).ravel() for i in range(0, len(own), WINDOWS)])
                item = np.concatenate([np.tile(np.array(own[i : i + WINDOWS]), REPETITIONS) for i in range(0, len(own), WINDOWS)])
                order = np.argsort(key)
                self.keys[n, back], self.item[n, back] = key[order], item[order]
        # A bit for each length that has the pair, modulo 64.
        self.bits = min(23, max(16, (64 * sum(map(len, self.words))).bit_length()))
        self.pairs = np.zeros(1 << self.bits, np.uint64)
        for w in self.words:
            self.pairs[(_bigrams(w) >> K.U(64 - self.bits)).astype(np.int64)] |= K.U(1 << len(w) % 64)

    def starts(self, n: int, most: int, at: np.ndarray, mask: np.ndarray, words: int) -> np.ndarray:
        """First words of windows that may hold a leak of an item of n words. at, mask: pairs of items, and of which lengths."""
        need, span = n - 1 - 2 * most, n + most - 1
        if need <= 0:
            return np.arange(words)
        p = at[(mask >> K.U(n % 64)) & K.U(1) == 1]
        if len(p) < need:
            return np.zeros(0, np.int64)
        first, last = p[: len(p) - need + 1], p[need - 1 :]
        near = last - first < span
        change = np.zeros(words + 1, np.int32)
        np.add.at(change, np.maximum(last[near] - span + 1, 0), 1)
        np.add.at(change, first[near] + 1, -1)
        return np.flatnonzero(np.cumsum(change[:-1]))

    def candidates(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (text, item, first word of the window in the slice), distinct. A window may begin before its text."""
        if not len(h) or not self.ids:
            return np.zeros((0, 3), np.int64)
        mask = self.pairs[(_bigrams(h) >> K.U(64 - self.bits)).astype(np.int64)]
        mask[~K.inside(first, 2, len(h))] = 0
        pair = np.flatnonzero(mask)
        mask = mask[pair]
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found = []
        for back in (False, True):
            if back:  # the same from the last word on
                h, first, text_of = h[::-1], len(h) - first[::-1], len(first) - 2 - text_of[::-1]
                pair, mask = len(h) - 2 - pair[::-1], mask[::-1]
            for n, way in self.walks:
                if way != back:
                    continue
                own = self.keys[n, back]
                start = self.starts(n, self.most[int(self.item[n, back][0])], pair, mask, len(h))
                for i in range(0, len(start), WINDOWS):
                    s = start[i : i + WINDOWS]
                    key = self.walks[n, back].keys(h, s, np.minimum(s + n, first[text_of[s] + 1])).ravel()
                    low = np.searchsorted(own, key, "left")
                    hit = np.flatnonzero(own[np.minimum(low, len(own) - 1)] == key)
                    if not len(hit):
                        continue
                    low, count = low[hit], np.searchsorted(own, key[hit], "right") - low[hit]
                    item = self.item[n, back][np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                    at = np.repeat(s[hit % len(s)], count)
                    rows = (len(first) - 2 - text_of[at], item, len(h) - at - n) if back else (text_of[at], item, at)
                    found.append(np.unique(np.stack(rows, 1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def leaks(self, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item) -> (distance, first word, end) of the best stretch, for texts that hold an item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for row, k, start in self.candidates(h, first).tolist():
            item, most, begin = self.words[k], self.most[k], int(first[row])
            if start < done.get((row, k), _NOTHING):
                continue
            low, high = max(begin, start - 2 * most), min(int(first[row + 1]), start + len(item) + 2 * most)
            part = h[low:high]
            near = fit(item, part, most) if shared(*self.distinct[k], part) >= len(item) - most else None
            # A leak that begins within `most` words of here lies in this stretch.
            done[row, k] = start + most + 1
            if near:
                got = (near[0], low + near[1] - begin, low + near[2] - begin)
                best[row, k] = min(best.get((row, k), got), got)
        return best


def _search(items):
    names = ["doc_id", "item_id", "start_word", "end_word", "distance", "item_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = items.value
        for batch in K.slices(batches, limit=SLICE_BYTES):
            best = it.leaks(*words(batch.column("text")))
            if best:
                ids = batch.column("doc_id").take(pa.array([row for row, _ in best]))
                rest = [[it.ids[k] for _, k in best], *[[v[i] for v in best.values()] for i in (1, 2, 0)], [len(it.words[k]) for _, k in best]]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in rest]], names)

    return run


def _without(items, text: str):
    """The rows that hold none of the items, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, text, SLICE_BYTES):
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, _ in items.value.leaks(*words(batch.column(text)))]] = False
            yield batch.filter(pa.array(keep))

    return run


def item_blocks(benchmark: DataFrame, item: str, item_text: str, max_rate: float, min_words: int, block_bytes: int) -> Iterator:
    """Broadcasts of the items, of about block_bytes of text each."""
    if not 0 <= max_rate < 1:
        raise ValueError(f"max_rate: {max_rate}")
    bench = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    bench = bench.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        rows = bench.where(F.col("block") == b).select("item_id", "text").toPandas()
        yield bench.sparkSession.sparkContext.broadcast(Items(rows["item_id"].tolist(), rows["text"].tolist(), max_rate, min_words))


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", max_rate: float = MAX_RATE, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, distance, item_words): the best stretch of each contaminated document for each item in it. max_rate is below 1."""
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kinds = "doc_id long, item_id long, start_word long, end_word long, distance long, item_words long"
    parts = [docs.mapInArrow(_search(block), kinds) for block in item_blocks(benchmark, item, item_text, max_rate, min_words, block_bytes)]
    return reduce(DataFrame.unionByName, parts).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", max_rate: float = MAX_RATE, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that no item contaminates. Each row is judged by its own text, whatever its id; nothing is shuffled."""
    for block in item_blocks(benchmark, item, item_text, max_rate, min_words, block_bytes):
        docs = docs.mapInArrow(_without(block, text), docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
