"""Substring dedup: seed by winnowed anchors, extend, keep repeats of `window` words and more.

Anchors are hashes of `seed` consecutive words; in every run of `window` words
the least of its anchors is a fingerprint of that run (winnowing), so two equal
runs always share one. Fingerprints that more than one document has are the
seeds. Around each seed, both ways, every run of `window` words that has it as
its fingerprint is hashed (96 bits), and runs meet by fingerprint and hash: that
extends a seed to all its partners at once, without forming pairs of them. A
word goes if a run that covers it also starts in a document with a smaller
doc_id; overlapping runs merge into maximal repeats.

Null and empty texts have no words and lose none. Of rows with equal doc_id
neither is smaller; each keeps its own row. A null doc_id is
larger than any other, and two nulls don't remove from each other. Texts of any
length are cut whole, and a stretch that one text repeats stays unless another
document has it. Empty tables give empty results, and columns other than id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .shared import bitmap, load, materialise

#: Bits (log2) of the filter of repeated seeds: 8 MB. Beyond a quarter as many seeds, documents get theirs by a join.
FILTER_BITS = 26
_LAST = (1 << 63) - 1


def _runs(column: pa.Array, window: int, seed: int):
    """Word hashes, first word of each text, starts of the runs of `window` words in one text, and their fingerprints."""
    data, offsets = K.texts(column)
    starts, ends, first = K.spans(data, offsets)
    h = K.hashes(data, starts, ends)
    ok = np.flatnonzero(K.inside(first, window, len(h)))
    least = K.window_min(K.grams(h, seed, 3), window - seed + 1)
    return h, first, ok, least[ok]


def _document(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, at, "right") - 1


def _fingerprints(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            _, first, at, least = _runs(batch.column("text"), window, seed)
            if not len(at):
                continue
            row = _document(first, at)
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            rows = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(least[new])), batch.column("doc_id").take(rows), batch.column("v").take(rows)], ["seed", "doc_id", "v"])

    return run


def _rows(at: np.ndarray, row: np.ndarray, first: np.ndarray, h: np.ndarray, h2: np.ndarray, n: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = pa.array(row)
    columns = [pa.array(K.signed(h)), pa.array((h2 >> K.U(32)).astype(np.uint32).view(np.int32)), batch.column("doc_id").take(rows), batch.column("v").take(rows), pa.array((at - first[row]) * 64 + n)]
    return pa.RecordBatch.from_arrays(columns, ["h", "h2", "doc_id", "v", "place"])


def _extended(window: int, seed: int, wanted, blocks, whole: bool):
    """Around each wanted seed, the runs that have it as their fingerprint: as blocks of neighbours if whole, else each of those in the wanted blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else np.frombuffer(wanted.value, np.int64)
        for batch in K.slices(batches):
            h, first, at, least = _runs(batch.column("text"), window, seed)
            if not len(at):
                continue
            if bits is not None:
                keep = K.in_bitmap(bits, FILTER_BITS, least)
            else:
                own = batch.column("seeds")
                row, keep = _document(first, at), np.zeros(len(at), bool)
                for r in np.unique(row):
                    of = row == r
                    keep[of] = np.isin(least[of], np.array(own[int(r)].as_py() or [], np.int64).view(K.U))
            at, least = at[keep], least[keep]
            if not len(at):
                continue
            row = _document(first, at)
            a = K.rolling(h, window, 0xD1342543DE82EF95)[at]
            b = least ^ K.rolling(h, window, 0xAF251AF3B0F025B5)[at]
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            # In periodic text the fingerprint stays the same: longer blocks are cut, so that both ends tell the words between them.
            i = np.arange(len(at))
            new |= (i - np.maximum.accumulate(np.where(new, i, 0))) % (window - seed + 1) == 0
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(at)))
            last = start + n - 1
            # First and last run overlap, so with their number they tell the block's words.
            k, k2 = K.mix(a[start] * K.U(3) + a[last] + n.astype(K.U)), K.mix(b[start] * K.U(3) + b[last] + n.astype(K.U))
            if whole:
                yield _rows(at[start], row[start], first, k, k2, n, batch)
                continue
            ids = batch.column("doc_id").take(pa.array(row[start])).fill_null(_LAST).to_numpy()
            keep = np.repeat(K.in_bitmap(np.frombuffer(blocks.value, np.int64), FILTER_BITS, k.view(np.int64) ^ ids), n)
            if keep.any():
                yield _rows(at[keep], row[keep], first, a[keep], b[keep], np.ones(keep.sum(), np.int64), batch)

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            kept, words, gone, spans = [], [], [], []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("starts")):
                w = split_words(text)
                words.append(len(w))
                if not at.is_valid or not len(at.values):
                    gone.append(0)
                    spans.append([])
                else:
                    n = at.values.field("n").to_numpy().astype(np.int64)
                    a = np.repeat(at.values.field("at").to_numpy() - np.cumsum(n) + n, n) + np.arange(n.sum())
                    a = np.unique(a)
                    breaks = np.flatnonzero(np.diff(a) > window) + 1
                    spans.append([{"start": int(s[0]), "end": int(s[-1]) + window} for s in np.split(a, breaks)])
                    gone.append(sum(s["end"] - s["start"] for s in spans[-1]))
                    for s in reversed(spans[-1]):
                        del w[s["start"] : s["end"]]
                kept.append(" ".join(w))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], ["doc_id", "n_words", "n_removed", "kept", "removed"])

    return run


def split_words(text: str | None) -> list[str]:
    r"""Words [^\x20\x09-\x0D]+. bytes.split() splits at just these six."""
    return [w.decode() for w in (text or "").encode().split()]


def repeated_starts(docs: DataFrame, window: int = 50, seed: int = 8, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, v, at, n): n consecutive runs of `window` words, the first at word `at`, that also start in documents with smaller doc_ids.

    docs: doc_id, text, and v, a hash of the text that tells rows of one doc_id apart. window - seed is at most 62."""
    sc = docs.sparkSession.sparkContext
    prints = docs.mapInArrow(_fingerprints(window, seed), "seed long, doc_id long, v int")
    order = F.coalesce("doc_id", F.lit(_LAST))
    seeds = materialise(prints.groupBy("seed").agg(F.min(order).alias("a"), F.max(order).alias("b")).where("a <> b").select("seed"), "seeds")
    if seeds.count() <= 1 << (filter_bits - 2):
        wanted, around = sc.broadcast(bitmap(seeds, "seed", FILTER_BITS)), docs
    else:
        # By text too, so that rows of one doc_id, or of none, don't gather in one.
        own = prints.join(seeds, "seed").groupBy("doc_id", "v").agg(F.collect_set("seed").alias("seeds"))
        wanted, around = None, docs.join(own, docs["doc_id"].eqNullSafe(own["doc_id"]) & (docs["v"] == own["v"])).select(docs["doc_id"], "text", docs["v"], "seeds")

    def meet(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("h", "h2").agg(F.min(order).alias("low")), ["h", "h2"])

    kind = "h long, h2 int, doc_id long, v int, place long"
    # Equal blocks meet first. Only a block's first document goes on to meet others run by run.
    blocks = materialise(meet(around.mapInArrow(_extended(window, seed, wanted, None, True), kind)), "blocks")
    mine = blocks.where(order == F.col("low")).select(F.col("h").bitwiseXOR(order).alias("key"))
    chosen = sc.broadcast(bitmap(mine, "key", FILTER_BITS))
    runs = meet(around.mapInArrow(_extended(window, seed, wanted, chosen, False), kind))
    return blocks.unionByName(runs).where(order > F.col("low")).select("doc_id", "v", F.shiftright("place", 6).alias("at"), (F.col("place") % 64).alias("n"))


def cut_repeats(docs: DataFrame, window: int = 50, seed: int = 8, id: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): kept has the words left, joined by one space; removed the spans [start, end) of words."""
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.hash(F.col(text)).alias("v"))
    starts = materialise(repeated_starts(docs, window, seed, filter_bits).groupBy("doc_id", "v").agg(F.collect_set(F.struct("at", "n")).alias("starts")), "starts")
    joined = docs.join(starts, docs["doc_id"].eqNullSafe(starts["doc_id"]) & (docs["v"] == starts["v"]), "left").select(docs["doc_id"], "text", "starts")
    return joined.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
