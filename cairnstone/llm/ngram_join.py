"""N-gram Jaccard self-join with several global token orders.

A document's set holds the hashes of its distinct k-word shingles. Two sets of
Jaccard similarity t or more share a token among the first n - ceil(t n) + 1
tokens of each under *any* global order, so candidates must do so under three
orders at once: they meet by an inverted list of their prefixes under the first
order, and stay only if their prefixes overlap under the second and third. Each
order puts frequent tokens last (by counts over the whole table) and breaks
ties by its own hash. Parity sketches, whose distance never exceeds the symmetric
difference (one of 512 bits, and for long sets one that grows with them), and a
size filter prune further; exact set intersection decides.

Equal sets are one node of the link graph, however many documents have them. In
an inverted list each node meets the list's pivot, its smallest set. Nodes that
this leaves in different components may still be linked with each other. Up to
WIDE of them compare their sketches in blocks, and only pairs that these leave go
on; a longer list meets by what its sets have besides the pivot: two linked sets
of which one isn't linked with the pivot share a token that only they or only the
pivot has. These differences make new lists, which are short where the old ones
were long, and so on; lists that are still longer after LEVELS rounds are compared
in blocks like the others. So a set is compared with a bounded number of others,
the pairs that go on are few, and no link that matters is lost.

Null and empty texts have an empty set and link with nothing; texts of any length
are read whole, a slice of a batch at a time; repeated rows are separate rows with
equal results, and rows of one doc_id but different texts each have their own; a
null doc_id takes part but is nobody's component_id unless no other is there;
empty tables give empty results; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import kernels as K
from .graph import components
from .shared import bitmap, bits_for, load, materialise

#: A token is frequent from so many documents on.
FREQUENT = 32
#: Entries of the broadcast table of frequent tokens; if more tokens are frequent, the least frequent of them count as rare.
FREQUENT_ENTRIES = 1 << 20
#: Tokens counted at once in a task.
COUNT_TOKENS = 1 << 20
#: Lists of so many sets compare sketches, so many in a block; longer ones meet by differences, in so many rounds.
WIDE = 8192
BLOCK = 512
LEVELS = 4
#: Sets of more tokens than this have a second sketch, of two to four bits for each token.
LONG = 1000
#: Sets that a task remembers as sent; beyond that it may send one again.
TASK_SETS = 1 << 16
#: Filters have 16 bits for each row up to so many rows (32 MB); beyond, documents get theirs by a join, and tokens pass more often.
FILTER_ROWS = 1 << 24
SKETCH = [f"s{i}" for i in range(8)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_sets(column: pa.Array, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = K.texts(column)
    if lower:
        data = _LOWER[data]
    starts, ends, first = K.spans(data, offsets)
    h = K.hashes(data, starts, ends)
    g = K.grams(h, k, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))]
        else:
            yield K.grams(h[a:b], b - a, b - a) if b > a else np.zeros(0, K.U)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def fingerprint(x: np.ndarray) -> int:
    return int((K.mix(x, 11).sum(dtype=K.U) + K.U(len(x))).view(np.int64)) if len(x) else 0


class Orders:
    """Global token orders: rare before frequent, then a hash for each order."""

    def __init__(self, tokens: bytes, ranks: bytes):
        self.tokens, self.ranks = np.frombuffer(tokens, K.U), np.frombuffer(ranks, np.uint8)

    def rank(self, x: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(x), K.U)
        at = np.minimum(np.searchsorted(self.tokens, x), len(self.tokens) - 1)
        return np.where(self.tokens[at] == x, self.ranks[at], 0).astype(K.U)

    def prefix(self, x: np.ndarray, p: int, order: int, rank: np.ndarray) -> np.ndarray:
        if p >= len(x):
            return x
        key = (rank << K.U(56)) | (K.mix(x, 100 + order) >> K.U(8))
        return x[np.argpartition(key, p - 1)[:p]]


def _counts(k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            token, n = token[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(K.signed(token)), pa.array(n.astype(np.int64))], ["token", "n"])

        for batch in K.slices(batches):
            for x in token_sets(batch.column("text"), k, lower):
                held.append(x)
                size += len(x)
            if size >= COUNT_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def orders(docs: DataFrame, k: int, lower: bool) -> tuple[bytes, bytes]:
    """Tokens and ranks for Orders. Counts run over the whole table; a task leaves out tokens that it sees once."""
    counts = docs.select("text").mapInArrow(_counts(k, lower), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    counts = materialise(counts, "frequent")
    steps = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("rank")).count().orderBy(F.desc("rank")).collect()
    total, least = 0, 1 << 30
    for step in steps:  # at most 256 rows
        total += step["count"]
        if total > FREQUENT_ENTRIES:
            break
        least = step["rank"]
    rows = counts.select("token", F.floor(F.log2("n") * 4).cast("int").alias("rank")).where(F.col("rank") >= least).toArrow()  # a million rows at most: as Python rows they would not fit a small driver
    tokens = rows["token"].to_numpy().view(K.U)
    order = np.argsort(tokens)
    return tokens[order].tobytes(), np.minimum(rows["rank"].to_numpy(), 255)[order].astype(np.uint8).tobytes()


def long_sketch(x: np.ndarray) -> bytes:
    """Parities of the tokens' bins; the bins are a power of two, so that a sketch folds into a smaller one."""
    bins = 1 << (2 * len(x) - 1).bit_length()
    return np.packbits(np.bincount((K.mix(x, 31) & K.U(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8) & 1).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)).sum())


def _close(percent: int):
    """Pairs of long sets whose second sketches let them be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.array([sketch_distance(a, b) for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())], np.int64)
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * far <= (100 - percent) * total))

    return run


def _compared(percent: int):
    """Pairs of one list and pair of blocks, of different components, that sizes and sketches leave. Rows come sorted by list and blocks."""
    names = ["key", "low", "high", "block", "fp", "c", "n", "sk", *SKETCH]

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n, c, fp, block = (t.column(x).to_numpy() for x in ("n", "c", "fp", "block"))
        sketch = np.stack([t.column(x).to_numpy() for x in SKETCH], 1).view(np.uint64)
        one = np.flatnonzero(block == t.column("low")[0].as_py())
        other = one if t.column("low")[0] == t.column("high")[0] else np.flatnonzero(block == t.column("high")[0].as_py())
        found = []
        for i in range(0, len(one), 128):
            a = one[i : i + 128]
            x, y = n[a][:, None], n[other][None]
            keep = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (c[a][:, None] != c[other][None])
            if other is one:
                keep &= fp[a][:, None] < fp[other][None]
            p, q = np.nonzero(keep)
            p, q = a[p], other[q]
            for j in range(0, len(p), 1 << 16):
                u, v = p[j : j + (1 << 16)], q[j : j + (1 << 16)]
                far = np.bitwise_count(sketch[u] ^ sketch[v]).sum(1, dtype=np.int64)
                near = (100 + percent) * far <= (100 - percent) * (n[u] + n[v])
                found.append((u[near], v[near]))
        u, v = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        if len(u):
            sk = t.column("sk").to_pylist()
            keep = [sk[i] is None or sk[j] is None or (100 + percent) * sketch_distance(sk[i], sk[j]) <= (100 - percent) * int(n[i] + n[j]) for i, j in zip(u.tolist(), v.tolist())]
            u, v = u[keep], v[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[u], fp[v])), pa.array(np.maximum(fp[u], fp[v]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            batch = batch.select(names)
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(x).to_numpy() for x in names[:3]], 1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cut[:-1], cut[1:]):
                part = batch.slice(a, b - a)
                if held and any(held[0].column(x)[0] != part.column(x)[0] for x in names[:3]):
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from pairs(pa.Table.from_batches(held))
        K.release()

    return run


def _nodes(k: int, lower: bool):
    names = ["doc_id", "version", "fp", "n", "sk", *SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            fp, n, sk, sketch = [], [], [], np.zeros((batch.num_rows, 64), np.uint8)
            for i, x in enumerate(token_sets(batch.column("text"), k, lower)):
                fp.append(fingerprint(x) if len(x) else None)
                n.append(len(x))
                sk.append(long_sketch(x) if len(x) > LONG else None)
                sketch[i] = np.packbits(np.bincount((K.mix(x, 13) >> K.U(55)).astype(np.int64), minlength=512).astype(np.uint8) & 1)
            columns = [pa.array(c) for c in sketch.view(np.int64).T.copy()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(sk, pa.binary()), *columns], names)

    return run


def _postings(k: int, lower: bool, percent: int, table, wanted=None):
    """Prefix tokens under the first order, of distinct sets; only those that the filter lets pass, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Orders(*table.value), set()
        bits = None if wanted is None else np.frombuffer(wanted.value, np.int64)
        for batch in K.slices(batches):
            token, fps, ns = [], [], []
            sets = [x for x in token_sets(batch.column("text"), k, lower) if len(x)]
            if not sets:
                continue
            ranks = np.split(order.rank(np.concatenate(sets)), np.cumsum([len(x) for x in sets])[:-1])
            for x, rank in zip(sets, ranks):
                fp = fingerprint(x)
                if fp in seen:
                    continue
                if len(seen) >= TASK_SETS:
                    seen.clear()
                seen.add(fp)
                p = order.prefix(x, prefix_length(len(x), percent), 1, rank)
                if bits is not None:
                    p = p[K.in_bitmap(bits, K.bits_of(bits), p)]
                token.append(p)
                fps.append(np.full(len(p), fp))
                ns.append(np.full(len(p), len(x)))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(np.concatenate(token))), pa.array(np.concatenate(fps)), pa.array(np.concatenate(ns))], ["token", "fp", "n"])

    return run


def _sets(k: int, lower: bool, percent: int, table, wanted):
    """Tokens of the documents whose ids the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Orders(*table.value), set()
        bits = None if wanted is None else np.frombuffer(wanted.value, np.int64)
        for batch in K.slices(batches):
            if bits is not None:
                batch = batch.filter(pa.array(K.in_bitmap(bits, K.bits_of(bits), batch.column("doc_id").fill_null(0).to_numpy())))
            rows = []
            for x in token_sets(batch.column("text"), k, lower):
                fp = fingerprint(x)
                if not len(x) or fp in seen:
                    continue
                if len(seen) >= TASK_SETS:
                    seen.clear()
                seen.add(fp)
                rank, p = order.rank(x), prefix_length(len(x), percent)
                # Low halves of tokens can only add overlaps to the filter.
                rows.append((fp, x.tobytes(), *[order.prefix(x, p, m, rank).astype(np.uint32).view(np.int32) for m in (2, 3)]))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["fp", "tokens", "p2", "p3"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ta"), batch.column("tb")):
                x, y = np.frombuffer(a.as_buffer(), K.U), np.frombuffer(b.as_buffer(), K.U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _deltas(percent: int, table):
    """Of each set (tokens ta) of a group with a pivot (tokens tb): the tokens by which it may meet its likes, keyed with the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Orders(*table.value)
        for batch in batches:
            key, fps = [], []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_numpy(), batch.column("ta"), batch.column("tb")):
                x, pivot = np.frombuffer(ta.as_buffer(), K.U), np.frombuffer(tb.as_buffer(), K.U)
                token = np.setdiff1d(x, pivot, assume_unique=True)
                # A linked set lacks at most `most` of x's tokens.
                most = (100 - percent) * len(x) // 100
                if len(token) > most:
                    token = order.prefix(token, most + 1, 1, order.rank(token))
                else:
                    token = np.concatenate((token, np.setdiff1d(pivot, x, assume_unique=True)))
                key.append(K.mix(token ^ K.mix(np.array([b], np.int64).view(K.U), 17), 19))
                fps.append(np.full(len(token), a, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(np.concatenate(key))), pa.array(np.concatenate(fps))], ["key", "fp"])

    return run


def _may_link(a: Callable[[str], F.Column], b: Callable[[str], F.Column], percent: int) -> F.Column:
    """Size and sketch filters; neither drops a pair of the wanted similarity."""
    far = sum((F.bit_count(a(s).bitwiseXOR(b(s))) for s in SKETCH[1:]), F.bit_count(a(SKETCH[0]).bitwiseXOR(b(SKETCH[0]))))
    near = 100 * F.least(a("n"), b("n")) >= percent * F.greatest(a("n"), b("n"))
    return near & ((100 + percent) * far <= (100 - percent) * (a("n") + b("n")))


def _jaccard(docs: DataFrame, k: int, percent: int, lower: bool) -> DataFrame:
    """docs: doc_id, version, text. Returns doc_id, version, n_shingles, component_id."""
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(orders(docs, k, lower))
    nodes = materialise(docs.mapInArrow(_nodes(k, lower), "doc_id long, version long, fp long, n long, sk binary, " + ", ".join(f"{s} long" for s in SKETCH)), "nodes")
    sets = nodes.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "sk", *SKETCH)])
    sets = materialise(sets, "sets")

    # Inverted lists under the first order, of two sets or more.
    kinds = "token long, fp long, n long"
    postings = docs.select("text").mapInArrow(_postings(k, lower, percent, table), kinds)
    shared = materialise(postings.groupBy("token").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("token"), "shared")
    wanted = sc.broadcast(bitmap(shared, "token", bits_for(shared.count())))
    postings = docs.select("text").mapInArrow(_postings(k, lower, percent, table, wanted), kinds)
    # Linked sets are of the same class of sizes or of adjacent ones; each set is in its class and the next.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")
    lists = postings.join(shared, "token", "left_semi").select(F.explode(F.array(band, band + 1)).alias("band"), "token", "fp", "n")
    lists = materialise(lists.select(F.xxhash64("token", "band").alias("key"), "fp", "n").distinct(), "lists")
    wanted.unpersist()

    def grouped(lists: DataFrame) -> DataFrame:
        """(b, a): a pivot, and each other set of its lists."""
        pivot = lists.groupBy("key").agg(F.min(F.struct("n", "fp")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("p.fp").alias("b"))
        return materialise(lists.join(pivot, "key").where("fp <> b").select("b", F.col("fp").alias("a")).distinct(), "groups")

    def close(pairs: DataFrame, name: str) -> DataFrame:
        """pairs: a, b, na, nb. Those that the long sets' sketches leave."""
        is_long = (F.col("na") > LONG) & (F.col("nb") > LONG)
        pairs = materialise(pairs, name)
        sk = sets.where(F.col("n") > LONG).select("fp", "sk")
        a, b = (sk.select(F.col("fp").alias(c), F.col("sk").alias(f"s{c}")) for c in "ab")
        long = pairs.where(is_long).join(a, "a").join(b, "b").mapInArrow(_close(percent), "a long, b long")
        return materialise(pairs.where(~is_long).select("a", "b").unionByName(long), name)

    def sketched(pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and sketches leave."""
        rows = sets.select("fp", "n", *SKETCH)
        a, b = (rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns]) for side in "ab")
        joined = pairs.join(a, F.col("a") == F.col("a_fp")).join(b, F.col("b") == F.col("b_fp"))
        return close(joined.where(_may_link(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), percent)).select("a", "b", F.col("a_n").alias("na"), F.col("b_n").alias("nb")), "candidates")

    full: DataFrame | None = None

    def fetch(ends: DataFrame) -> None:
        """Brings tokens, and prefixes under the other orders, of sets that are not there yet. Of equal sets the first document's is read."""
        nonlocal full
        ends = ends if full is None else ends.join(full.select("fp"), "fp", "left_anti")
        ends = materialise(ends.join(sets.select("fp", "rep"), "fp").select("fp", F.coalesce("rep", F.lit(0)).alias("key")), "ends")
        n, of, wanted = ends.count(), docs, None
        if not n:
            return
        if n <= FILTER_ROWS:
            wanted = sc.broadcast(bitmap(ends, "key", bits_for(n)))
        else:
            of = docs.join(ends.select("key").distinct(), F.coalesce("doc_id", F.lit(0)) == F.col("key"), "left_semi")
        more = of.select("doc_id", "text").mapInArrow(_sets(k, lower, percent, table, wanted), "fp long, tokens binary, p2 array<int>, p3 array<int>")
        more = materialise(more.join(ends.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "tokens")
        if wanted is not None:
            wanted.unpersist()
        full = more if full is None else full.unionByName(more)

    def with_tokens(pairs: DataFrame) -> DataFrame:
        blobs = full.select("fp", "tokens")
        return pairs.join(blobs.select(F.col("fp").alias("a"), F.col("tokens").alias("ta")), "a").join(blobs.select(F.col("fp").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that also share prefix tokens under the other orders, and then have the similarity."""
        prefixes = full.select("fp", "p2", "p3")
        kept = pairs.join(prefixes.select(F.col("fp").alias("a"), F.col("p2").alias("a2"), F.col("p3").alias("a3")), "a").join(prefixes.select(F.col("fp").alias("b"), F.col("p2").alias("b2"), F.col("p3").alias("b3")), "b")
        kept = kept.where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")
        return materialise(with_tokens(kept).mapInArrow(_verify(percent), "a long, b long"), "links")

    def ends_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()

    groups = grouped(lists)
    candidates = sketched(groups)
    fetch(ends_of(candidates))
    links = verified(candidates) if full is not None else candidates
    label = materialise(components(links, "a", "b"), "labels")
    members, by_group = groups, True
    for level in range(LEVELS + 1):
        # Members of one key: here all sets of a pivot but itself, further down the sets of a list.
        rows = (members.select(F.col("b").alias("key"), F.col("a").alias("fp")) if by_group else members.select("key", "fp"))
        rows = rows.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("c"))
        apart = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 <> c1").select("key", "size")
        rows = materialise(rows.join(apart, "key"), "apart")
        if rows.isEmpty():
            break
        listed = rows if level == LEVELS else rows.where(F.col("size") <= WIDE)
        blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        listed = listed.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", other)
        listed = listed.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp", "c")
        # Sketches join before the rows are dealt by list, so that they are moved once for each row.
        listed = listed.join(sets.select("fp", "n", "sk", *SKETCH), "fp").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        pairs = materialise(listed.select("key", "low", "high", "block", "fp", "c", "n", "sk", *SKETCH).mapInArrow(_compared(percent), "a long, b long").distinct(), "pairs")
        large = rows.where(F.col("size") > WIDE)
        deep = level < LEVELS and not large.isEmpty()
        if deep and not by_group:
            # A long list of differences: its pivot meets all, and their differences go on.
            own = lists.join(large.select("key").distinct(), "key", "left_semi")
            groups = grouped(own)
            pairs = materialise(pairs.unionByName(sketched(groups)).distinct(), "pairs")
        elif deep:
            groups = large.select(F.col("key").alias("b"), F.col("fp").alias("a"))
        fetch(ends_of(pairs).unionByName(ends_of(groups)).distinct() if deep else ends_of(pairs))
        if deep:
            found = materialise(with_tokens(groups).mapInArrow(_deltas(percent, table), "key long, fp long").distinct(), "deltas")
            again = found.groupBy("key").agg(F.min("fp").alias("a0"), F.max("fp").alias("a1")).where("a0 <> a1").select("key")
            lists = materialise(found.join(again, "key", "left_semi").join(sets.select("fp", "n"), "fp").select("key", "fp", "n"), "lists")
        if full is not None:
            links = links.unionByName(verified(pairs))
            label = materialise(components(links, "a", "b"), "labels")
        if not deep:
            break
        members, by_group = lists, False

    member = sets.select("fp", "rep").join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    smallest = member.groupBy("c").agg(F.min("rep").alias("smallest"))
    of = member.join(smallest, "c").select("fp", "smallest")
    # An empty set is a component of its own; its fp is null, so the hot value never meets the join.
    out = nodes.where("n > 0").select("doc_id", "version", "fp", "n").join(of, "fp").select("doc_id", "version", F.col("n").alias("n_shingles"), F.col("smallest").alias("component_id"))
    return out.unionByName(nodes.where("n = 0").select("doc_id", "version", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _versions(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id: str = "doc_id", text: str = "text", lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: links are pairs with Jaccard similarity >= percent / 100."""
    return _jaccard(_versions(docs, id, text), k, percent, lower).drop("version")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, of each component only those with its smallest doc_id; rows with an empty set or a null id all stay.

    A row goes for its own text: another of the same doc_id stays if its text is linked with none of a smaller id."""
    found = _jaccard(_versions(docs, id, text), k, percent, True)
    gone = found.where(F.col("doc_id").isNotNull() & (F.col("component_id") < F.col("doc_id"))).select(F.col("doc_id").alias("_gone"), F.col("version").alias("_version")).distinct()
    return docs.join(gone, (docs[id] == gone["_gone"]) & (F.xxhash64(docs[text]) == gone["_version"]), "left_anti")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))
