import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnstone.functions import formatting as N, placement as P


def one(spark, column, value, kind="double"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


@pytest.mark.parametrize("f, x, want", [
    (N.bytes_, 0.4, "0 B"), (N.bytes_, 0.0, "0 B"), (N.bytes_, float("nan"), "—"), (N.bytes_, 1234567.0, "1.2 MB"), (N.bytes_, 999e9, "999 GB"),
    (N.bibytes, -0.4, "-0 B"), (N.bibytes, 134217728.0, "128 MiB"), (N.rate, 0.0, "—"), (N.rate, 1500.0, "1.5 KB/s"),
    (N.count, 4201882.0, "4.2M"), (N.count, 999.0, "999"), (N.duration, 59.9, "1m"), (N.duration, 119.9, "2m"), (N.duration, 3599.9, "1h 0m"), (N.duration, -1.0, "—"), (N.duration, 0.5, "500ms"),
    (N.ms, 0.0, "0 ms"), (N.ms, 9.96, "10.0 ms"), (N.ms, 41.8, "42 ms"),
])
def test_numbers(spark, f, x, want):
    assert one(spark, f(F.col("x")), x) == want


@pytest.mark.parametrize("text, want", [("128MiB", 128 << 20), ("1 KB", 1024), ("7", 7), ("banana", None)])
def test_sizes(spark, text, want):
    assert one(spark, N.parse_size(F.col("x")), text, "string") == want


def test_paths(spark):
    assert one(spark, N.file_href(F.col("x")), "/", "string") == "/files"
    assert one(spark, N.file_href(F.col("x")), "/a b/50%", "string") == "/files/a%20b/50%25"
    assert one(spark, N.parent_of(F.col("x")), "/a/b/c", "string") == "/a/b"
    assert one(spark, N.breadcrumbs(F.col("x")), "/a/b", "string") == ["/", "/a", "/a/b"]


def test_bars_have_their_width(spark):
    rows = spark.range(101).select(N.bar(F.col("id") / 100, 16).alias("b")).collect()
    assert all(len(r["b"]) == 16 for r in rows) and rows[0]["b"].strip() == "" and rows[100]["b"] == "█" * 16
    assert one(spark, N.sparkline(F.col("x")), [1.0, 1.0], "array<double>") == "▁▁"


def mix32(x):
    for shift, m in ((16, P.MIX32[0]), (15, P.MIX32[1])):
        x = (x ^ x >> shift) * m & 0xFFFFFFFF
    return x ^ x >> 16


def test_mix32_is_that_of_whole_numbers(spark):
    xs = [0, 1, 5, 65535, 65536, 2**31, 2**32 - 1, 123456789]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select(P.mix32(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == [mix32(x) for x in xs]


def mix64(x):
    for m in P.MIX64:
        x = (x ^ x >> 33) * m & (2**64 - 1)
    return x ^ x >> 33


def test_mix64_and_weights():
    xs = [0, 1, 2**63, 2**64 - 1, 12345]
    assert P.mix64(np.array(xs, np.uint64)).tolist() == [mix64(x) for x in xs]
    assert P.weighted_score(np.array([1]), np.array([2]), np.array([0.0]))[0] == -np.inf


def nodes(spark, n):
    return spark.createDataFrame([(f"w{i}", i, f"r{i % 3}", float(1 + i % 2)) for i in range(1, n + 1)], "node string, num long, rack string, weight double")


@pytest.mark.parametrize("place", ["32", "64"])
def test_racks_and_disruption(spark, place):
    blocks = spark.range(1000).withColumnRenamed("id", "block")

    def sets(n):
        at = nodes(spark, n)
        out = P.rendezvous32(blocks, at, 3) if place == "32" else P.rendezvous64(blocks, at.withColumn("seed", F.col("num")), 3)
        got = {}
        for r in out.collect():
            got.setdefault(r["block"], set()).add((r["node"], r["rack"]))
        return got

    a, b = sets(12), sets(11)
    assert all(len({rack for _, rack in s}) == 3 for s in a.values())
    assert sum(a[k] != b[k] for k in a) < 300


def weighted_by_hand(block, at, n):
    score = {r[0]: P.weighted_score(np.array([block]), np.array([r[2]]), np.array([r[3]]))[0] for r in at}
    ranked, firsts, rest = sorted(at, key=lambda r: (-score[r[0]], r[0])), [], []
    for r in ranked:
        (rest if any(f[1] == r[1] for f in firsts) else firsts).append(r)
    return [(block, i, r[0], r[1]) for i, r in enumerate((firsts + rest)[:n], 1)]


@pytest.mark.parametrize("most", [4096, 5])
def test_weighted_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(P, "MOST_NODES", most)
    at = nodes(spark, 30).withColumn("seed", F.col("num")).withColumn("weight", F.when(F.col("num") % 7 == 0, 0.0).otherwise(F.col("weight")))
    listed = [tuple(r) for r in at.select("node", "rack", "seed", "weight").collect()]
    for k in (3, 5, 40):
        got = sorted(map(tuple, P.rendezvous64(spark.range(200).withColumnRenamed("id", "block"), at, k).select("block", "place", "node", "rack").collect()))
        assert got == [r for b in range(200) for r in weighted_by_hand(b, listed, k)]


def test_weighted_query_places_on_every_supplier(spark):
    from cairnstone.plans import placed

    sf = "/root/testdata/sf0.01"
    rack = {r["num"]: r["rack"] for r in placed.table(spark, sf, "supplier").join(placed.table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey")).join(placed.table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey")).selectExpr("s_suppkey num", "r_name rack").collect()}
    listed = [(f"w{i}", r, i, float(1 + i % 3)) for i, r in rack.items()]
    out = placed.hrw_place_weighted(spark, sf).where("block <= 100").select("block", "place", "node", "rack")
    got = sorted(map(tuple, out.collect()))
    assert len(listed) > placed.NODES and got == [r for b in sorted({g[0] for g in got}) for r in weighted_by_hand(b, listed, 3)]


@pytest.mark.parametrize("m, n", [(65, 3), (300, 7), (20_000, 3)])
def test_high_bids_place_as_all_bids_do(m, n):
    """Tiles, the table of high scores (20 000 nodes, near blocks), racks that high bids leave out, nodes without weight."""
    r = np.random.default_rng(m)
    rack, num = np.minimum(r.geometric(0.3, m) - 1, 4), np.arange(m)
    rack[:5] = range(5)
    weight = np.where(num % 50 == 7, 0.0, 1.0 + num % 3)
    for bids in (P.Bids32(num), P.Bids64(num, weight)):
        for blocks in (np.arange(5000, 5200), np.unique(r.integers(0, 1 << 32, 40))):
            want = np.concatenate([P._chosen(bids.all(blocks[i : i + 8]), P._racks(rack), n) for i in range(0, len(blocks), 8)])
            assert (P._best(bids, blocks, rack, n) == want).all()
    dense, bids = np.arange(1 << 15), P.Bids32(num)
    got = P._best(bids, dense, rack, n)
    some = np.arange(0, 1 << 15, 1111)
    assert (got[some] == np.concatenate([P._chosen(bids.all(dense[i : i + 1]), P._racks(rack), n) for i in some])).all()
    assert (bids.numbers is not None) == (m == 20_000)


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_disruption_of_many_nodes(spark, monkeypatch, most):
    monkeypatch.setattr(P, "MOST_NODES", most)
    m = 5000 if most > 5 else 30
    blocks, at = spark.range(300).withColumnRenamed("id", "block"), nodes(spark, m)
    gone, rack, num = f"w{m}", np.arange(1, m + 1) % 3, np.arange(1, m + 1)
    order = np.argsort([f"w{i}" for i in num])
    rack, num = rack[order], num[order]
    kept = num != m
    before = num[P._chosen(P.score32(np.arange(300), num), P._racks(rack), 3)]
    after = num[kept][P._chosen(P.score32(np.arange(300), num[kept]), P._racks(rack[kept]), 3)]
    moved = (np.sort(before, 1) != np.sort(after, 1)).any(1).sum()
    assert tuple(P.disruption32(blocks, at, gone, 3).first()) == (300, moved)


def test_modulo_rule():
    ring = [("a", "r1"), ("b", "r1"), ("c", "r2"), ("d", "r2"), ("e", "r3")]
    assert P.modulo(ring, 0) == ["a", "c", "d"] and P.modulo(ring, 3) == ["d", "e"] and P.modulo(ring, 4) == ["e", "a", "b"]
