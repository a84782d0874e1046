"""Deterministic replica placement: rendezvous hashing in 32 and 64 bits, and the modulo rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

_LOW = 0xFFFFFFFF
# The multipliers of the mixing functions and of node seeds.
MIX32 = (0x7FEB352D, 0x846CA68B)
MIX64 = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
SEED = 0x9E3779B1
#: Nodes up to which a placement broadcasts them; more are ranked in groups.
MOST_NODES = 1 << 20
#: Scores of blocks and nodes that a task holds at once, and that are made at once while only the highest stay.
_SCORES = 1 << 20
_TILE = 1 << 15
#: Blocks ranked at once. Up to FEW nodes are ranked whole; of more, about TOP for each block score high enough to be looked at.
_BLOCKS = 1 << 16
FEW = 64
TOP = 16
#: High scores of 32 bits that a task may hold as a table of all numbers that have them.
TABLE = 1 << 22
#: Blocks whose numbers differ in so many low bits read the table together.
GROUP_BITS = range(10, 19)


def times32(x: Column, m: int) -> Column:
    """x * m modulo 2**32 by 16-bit limbs: no product leaves 64 bits."""
    high = F.shiftright(x, 16) * (m & 0xFFFF) + x.bitwiseAND(F.lit(0xFFFF)) * (m >> 16)
    return (high.bitwiseAND(F.lit(0xFFFF)) * 65536 + x.bitwiseAND(F.lit(0xFFFF)) * (m & 0xFFFF)).bitwiseAND(F.lit(_LOW))


def mix32(x: Column) -> Column:
    h = x.cast("long").bitwiseAND(F.lit(_LOW))
    h = h.bitwiseXOR(F.shiftright(h, 16))
    h = times32(h, MIX32[0])
    h = h.bitwiseXOR(F.shiftright(h, 15))
    h = times32(h, MIX32[1])
    return h.bitwiseXOR(F.shiftright(h, 16))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(MIX64[0])
    x ^= x >> np.uint64(33)
    x *= np.uint64(MIX64[1])
    return x ^ (x >> np.uint64(33))


def weighted_score(block: np.ndarray, seed: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A node's bid for a block; twice the weight wins twice as often."""
    u = (mix64(block.astype(np.uint64) ^ mix64(seed)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.where(weight > 0, -weight / np.log(np.maximum(u, np.finfo(np.float64).tiny)), -np.inf)


def _bids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        s = weighted_score(c["block"].to_numpy(), c["seed"].to_numpy(), c["weight"].to_numpy())
        yield pa.RecordBatch.from_arrays([c["block"], c["node"], c["rack"], pa.array(s)], ["block", "node", "rack", "score"])


def best_of(bids: DataFrame, n: int) -> DataFrame:
    """The n best nodes of each block, the best of each rack before any second of a rack. bids: block, node, rack, score.

    bids has a row for each block and node; nodes are a cluster's (a few thousand), blocks any number, and each
    block is ranked in its own group."""
    in_rack = F.row_number().over(Window.partitionBy("block", "rack").orderBy(F.desc("score"), "node"))
    place = F.row_number().over(Window.partitionBy("block").orderBy(F.col("in_rack") > 1, F.desc("score"), "node"))
    return bids.withColumn("in_rack", in_rack).withColumn("place", place).where(F.col("place") <= n).select("block", "place", "node", "rack")


def _listed(nodes: DataFrame) -> pa.Table | None:
    """The rows of nodes (the first column is the node) in the order of nodes; None if they are more than MOST_NODES."""
    rows = nodes.limit(MOST_NODES + 1).toArrow()
    return rows.take(pc.sort_indices(rows.column(0))).combine_chunks() if len(rows) <= MOST_NODES else None


def _chosen(s: np.ndarray, racks: list[np.ndarray], n: int) -> np.ndarray:
    """Of scores by block and node, each block's n best nodes: the best of each rack before any second of a rack."""
    best = np.stack([r[s[:, r].argmax(1)] for r in racks], 1)
    if len(racks) >= n:
        return np.take_along_axis(best, np.lexsort((best, -np.take_along_axis(s, best, 1))), 1)[:, :n]
    later = np.ones(s.shape, bool)
    np.put_along_axis(later, best, False, 1)
    # Stable, so equal scores stay in the order of nodes.
    return np.lexsort((-s, later))[:, :n]


def _racks(rack: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(rack == r) for r in dict.fromkeys(rack.tolist())]


def score32(block: np.ndarray, num: np.ndarray) -> np.ndarray:
    return _mix32(block.astype(np.uint32)[:, None] ^ _seed32(num)[None]).astype(np.int64)


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(MIX32[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(MIX32[1])
    x ^= x >> np.uint32(16)
    return x


def _unmix32(y: np.ndarray) -> np.ndarray:
    """The number whose _mix32 is y."""
    x = (y ^ (y >> np.uint32(16))) * np.uint32(pow(MIX32[1], -1, 1 << 32))
    x = (x ^ (x >> np.uint32(15)) ^ (x >> np.uint32(30))) * np.uint32(pow(MIX32[0], -1, 1 << 32))
    return x ^ (x >> np.uint32(16))


def _seed32(num: np.ndarray) -> np.ndarray:
    return _mix32(num.astype(np.uint32) * np.uint32(SEED))


def _score64(block: np.ndarray, seed: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return weighted_score(block[:, None], seed.astype(np.int64)[None], weight.astype(np.float64)[None])


def _tiles(blocks: np.ndarray, nodes: int, high: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) where high, a matrix by block and node, holds."""
    step, found = max(1, _TILE // nodes), [np.zeros((2, 0), np.int64)]
    for i in range(0, len(blocks), step):
        row, node = np.divmod(np.flatnonzero(high(blocks[i : i + step])), nodes)
        found.append(np.stack((row + i, node)))
    return tuple(np.concatenate(found, 1))


class Bids32:
    """High bids of 32 bits. A bid is a mixed block ^ seed, and mixing can be undone: with many nodes few bids are high
    enough, and the numbers that give them fit a table. Blocks that differ in low bits only then read, for each node,
    one stretch of it; the work grows with the bids found, not with blocks times nodes."""

    def __init__(self, num: np.ndarray):
        self.num, self.seed = num, _seed32(num)
        self.least = (1 << 32) - min(1 << 32, TOP * (1 << 32) // len(num))
        self.numbers, self.starts = None, {}

    def all(self, blocks: np.ndarray) -> np.ndarray:
        return score32(blocks, self.num)

    def high(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, node, score) of all bids from `least` on; blocks: sorted, distinct."""
        m, size = len(self.num), (1 << 32) - self.least
        cost = {k: (1 + int(np.count_nonzero(np.diff(blocks >> k)))) * (m + 4 * (TOP << k)) for k in GROUP_BITS}
        k = min(cost, key=cost.get)
        if size > TABLE or 2 * cost[k] > m * len(blocks) or blocks[0] < 0 or blocks[-1] >> 32:
            row, node = _tiles(blocks, m, lambda b: _mix32(b.astype(np.uint32)[:, None] ^ self.seed[None]) >= np.uint32(self.least))
            return row, node, _mix32(blocks[row].astype(np.uint32) ^ self.seed[node]).astype(np.int64)
        if self.numbers is None:
            self.numbers = np.sort(_unmix32(np.arange(self.least, 1 << 32, dtype=np.uint32)))
        if k not in self.starts:
            self.starts[k] = np.searchsorted(self.numbers, np.arange((1 << 32 - k) + 1) << k)
        at, found = self.starts[k], []
        cuts = [0, *(np.flatnonzero(np.diff(blocks >> k)) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            row_of = np.full(1 << k, -1)
            row_of[blocks[a:b] & ((1 << k) - 1)] = np.arange(a, b)
            stretch = (self.seed >> np.uint32(k)) ^ np.uint32(blocks[a] >> k)
            low, count = at[stretch], at[stretch + np.uint32(1)] - at[stretch]
            node = np.repeat(np.arange(m), count)
            x = self.numbers[np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)]
            row = row_of[(x ^ self.seed[node]) & np.uint32((1 << k) - 1)]
            there = row >= 0
            found.append(np.stack((row[there], node[there], _mix32(x[there]).astype(np.int64))))
        return tuple(np.concatenate(found, 1))


class Bids64:
    """High weighted bids. Whether a bid is high shows in the first bits of its hash, by the node's weight; logarithms are taken of those that are."""

    def __init__(self, seed: np.ndarray, weight: np.ndarray):
        self.seed, self.weight = seed, weight
        self.least = float(weight[weight > 0].sum()) / TOP
        x = mix64(seed.astype(np.uint64))
        self.start = x ^ (x >> np.uint64(33))
        with np.errstate(all="ignore"):
            # A little less than the hash that bids `least`, cut to the bits that mixing's last step leaves alone.
            share = np.where(weight > 0, np.exp(-weight / self.least * (1 + 1e-9)) - 2.0**-50, 1.0)
        self.cut = (np.clip(share, 0, 1 - 2.0**-33) * 2.0**33).astype(np.uint64) << np.uint64(31)

    def all(self, blocks: np.ndarray) -> np.ndarray:
        return _score64(blocks, self.seed, self.weight)

    def high(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, node, score) of all bids from `least` on."""

        def high(b: np.ndarray) -> np.ndarray:
            b = b.astype(np.uint64)
            x = (b ^ (b >> np.uint64(33)))[:, None] ^ self.start[None]
            x *= np.uint64(MIX64[0])
            x ^= x >> np.uint64(33)
            x *= np.uint64(MIX64[1])
            return x >= self.cut[None]

        row, node = _tiles(blocks, len(self.seed), high)
        score = weighted_score(blocks[row], self.seed[node].astype(np.int64), self.weight[node])
        there = score >= self.least
        return row[there], node[there], score[there]


def _best(bids: Bids32 | Bids64, blocks: np.ndarray, rack: np.ndarray, n: int) -> np.ndarray:
    """Each block's n best nodes (all, if fewer), the best of each rack before any second of a rack; blocks: sorted, distinct.

    High bids decide where they are of n racks, or of all racks and enough of them; other blocks see all their bids."""
    m, racks = len(rack), _racks(rack)
    n = min(n, m)
    out, rest = np.zeros((len(blocks), n), np.int64), np.arange(len(blocks))
    if m > max(FEW, n):
        row, node, score = bids.high(blocks)
        order = np.lexsort((node, -score, row))
        row, node = row[order], node[order]
        in_rack = np.argsort(row * (int(rack.max()) + 1) + rack[node], kind="stable")
        first = np.ones(len(row), bool)
        first[in_rack[1:]] = (row[in_rack[1:]] != row[in_rack[:-1]]) | (rack[node[in_rack[1:]]] != rack[node[in_rack[:-1]]])
        total, firsts = (np.bincount(row, w, len(blocks)).astype(np.int64) for w in (None, first))
        before = np.concatenate(([0], np.cumsum(first)))
        start = np.cumsum(total) - total
        firsts_before = before[:-1] - before[start[row]]
        place = np.where(first, firsts_before, firsts[row] + np.arange(len(row)) - start[row] - firsts_before)
        enough = (firsts >= n) | ((firsts == len(racks)) & (total >= n))
        shown = (place < n) & enough[row]
        out[row[shown], place[shown]] = node[shown]
        rest = np.flatnonzero(~enough)
    step = max(1, _SCORES // m)
    for i in range(0, len(rest), step):
        out[rest[i : i + step]] = _chosen(bids.all(blocks[rest[i : i + step]]), racks, n)
    return out


def _tops(batches: Iterator[pa.RecordBatch], bids: Bids32 | Bids64, rack: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted block numbers, so many at once, and the best nodes of each."""
    held: list[np.ndarray] = []

    def best() -> tuple[np.ndarray, np.ndarray]:
        distinct, of = np.unique(np.concatenate(held), return_inverse=True)
        return distinct[of], _best(bids, distinct, rack, n)[of]

    for batch in batches:
        held.append(batch.column("block").to_numpy())
        if sum(map(len, held)) >= _BLOCKS:
            yield best()
            held = []
    if sum(map(len, held)):
        yield best()


def _dealt(blocks: DataFrame) -> DataFrame:
    """Blocks by ranges of numbers, so that near ones come together; many small tasks, since the nodes make the work."""
    spark = blocks.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    block = F.col("block").cast("long").alias("block")
    return blocks.select(block).repartition(parts, F.shiftright("block", 14)).sortWithinPartitions("block")


def _placed(nodes, kind: type, n: int):
    """nodes: broadcast table of node, rack and what kind takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = nodes.value
        names, racks = t.column(0).combine_chunks(), t.column(1).combine_chunks()
        bids, rack = kind(*[c.to_numpy() for c in t.columns[2:]]), _codes(racks)
        for block, top in _tops(batches, bids, rack, n):
            at = pa.array(top.ravel())
            place = np.tile(np.arange(1, top.shape[1] + 1, dtype=np.int32), len(block))
            for i in range(0, len(at), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block, top.shape[1])[s]), pa.array(place[s]), names.take(at[s]), racks.take(at[s])], ["block", "place", "node", "rack"])

    return run


def _codes(racks: pa.Array) -> np.ndarray:
    return racks.dictionary_encode("encode").indices.to_numpy().astype(np.int64)


_PLACED = "block long, place int, node string, rack string"


def rendezvous32(blocks: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """blocks: block (below 2**32). nodes: node, num, rack.

    Up to MOST_NODES nodes are broadcast and ranked for each block where it is, by their high bids; more are ranked in
    groups."""
    nodes = nodes.select("node", "rack", F.col("num").cast("long").bitwiseAND(F.lit(_LOW)).alias("num"))
    listed = _listed(nodes)
    if listed is None:
        offers = nodes.select("node", "rack", mix32(times32(F.col("num"), SEED)).alias("seed"))
        return best_of(blocks.crossJoin(offers).select("block", "node", "rack", mix32(F.col("block").bitwiseXOR(F.col("seed"))).alias("score")), n)
    if not len(listed):
        return blocks.sparkSession.createDataFrame([], _PLACED)
    return _dealt(blocks).mapInArrow(_placed(blocks.sparkSession.sparkContext.broadcast(listed), Bids32, n), _PLACED)


def disruption32(blocks: DataFrame, nodes: DataFrame, gone: str, n: int) -> DataFrame:
    """(blocks, moved): how many blocks there are, and of how many the n nodes change when the node `gone` leaves.

    They change where it is one of them, and nowhere else: a node that leaves from behind the n gives up no place among them."""
    moved = rendezvous32(blocks, nodes, n).where(F.col("node") == gone).select("block").distinct()
    counted = blocks.select(F.col("block").cast("long").alias("block")).join(moved.withColumn("m", F.lit(1)), "block", "left")
    return counted.agg(F.count(F.lit(1)).alias("blocks"), F.count("m").alias("moved"))


def rendezvous64(blocks: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """nodes: node, rack, seed (long), weight.

    Up to MOST_NODES of them are broadcast and ranked for each block where it is; more are ranked in groups. Every
    node's hash is made for every block."""
    nodes = nodes.select("node", "rack", F.col("seed").cast("long"), F.col("weight").cast("double"))
    listed = _listed(nodes)
    if listed is None:
        pairs = blocks.crossJoin(nodes)
        return best_of(pairs.mapInArrow(_bids, "block long, node string, rack string, score double"), n)
    if not len(listed):
        return blocks.sparkSession.createDataFrame([], _PLACED)
    return _dealt(blocks).mapInArrow(_placed(blocks.sparkSession.sparkContext.broadcast(listed), Bids64, n), _PLACED)


def modulo(workers: list[tuple[str, str]], block: int, replicas: int = 3) -> list[str]:
    """First by number, second the next of another rack, third the next of the second's rack."""
    start = block % len(workers)
    ring = workers[start:] + workers[:start]
    other = next((i for i, (_, rack) in enumerate(ring) if rack != ring[0][1]), None)
    picks = [0]
    if replicas > 1 and other is not None:
        picks.append(other)
        after = [*range(other + 1, len(ring)), *range(1, other)]
        picks += [i for i in after if ring[i][1] == ring[other][1]][: int(replicas > 2)]
    return [ring[i][0] for i in picks]


def modulo_place(blocks: DataFrame, workers: list[tuple[str, str]], replicas: int = 3) -> DataFrame:
    """A block's replicas depend on its number modulo the cluster's size alone: one literal row for each remainder."""
    table = F.array(*[F.array(*[F.lit(w) for w in modulo(workers, r, replicas)]) for r in range(len(workers))])
    return blocks.select("block", F.posexplode(F.element_at(table, (F.col("block") % len(workers) + 1).cast("int"))).alias("place", "node"))
