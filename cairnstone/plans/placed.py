"""Placement queries: orders are blocks, suppliers are nodes, regions are racks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import placement as P
from ..registry import query
from ..sources.tables import table

#: Nodes of the ring that modulo_place places on; the others place on every supplier.
NODES = 12


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.concat(F.lit("w"), "s_suppkey").alias("node"), F.col("s_suppkey").alias("num"), F.col("r_name").alias("rack"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block"))


def _bids(nodes: str, k: str = "") -> str:
    """mix32 in HUGEINT arithmetic: an independent derivation of the scores."""
    step = lambda x, k: f"xor({x}, {x} >> {k})"
    a, b = P.MIX32
    return f"""n{k} AS (SELECT concat('w', s_suppkey) AS node, r_name AS rack, CAST(CAST(s_suppkey AS HUGEINT) * {P.SEED} % 4294967296 AS BIGINT) AS s0 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {nodes}),
s1{k} AS (SELECT *, CAST(CAST({step('s0', 16)} AS HUGEINT) * {a} % 4294967296 AS BIGINT) AS x FROM n{k}), s2{k} AS (SELECT *, CAST(CAST({step('x', 15)} AS HUGEINT) * {b} % 4294967296 AS BIGINT) AS y FROM s1{k}),
s3{k} AS (SELECT node, rack, {step('y', 16)} AS seed FROM s2{k}),
b0{k} AS (SELECT o_orderkey AS block, node, rack, xor(o_orderkey, seed) AS z FROM orders, s3{k}),
b1{k} AS (SELECT *, CAST(CAST({step('z', 16)} AS HUGEINT) * {a} % 4294967296 AS BIGINT) AS x FROM b0{k}), b2{k} AS (SELECT *, CAST(CAST({step('x', 15)} AS HUGEINT) * {b} % 4294967296 AS BIGINT) AS y FROM b1{k}),
bids{k} AS (SELECT block, node, rack, {step('y', 16)} AS score FROM b2{k}),
q{k} AS (SELECT *, row_number() OVER (PARTITION BY block, rack ORDER BY score DESC, node) AS r FROM bids{k}),
best{k} AS (SELECT block, node, rack, CAST(row_number() OVER (PARTITION BY block ORDER BY r > 1, score DESC, node) AS INTEGER) AS place FROM q{k})"""


#: SQL of every block's ranking of nodes, as table best.
BIDS = _bids("true")


@query("hrw_place", f"WITH {BIDS} SELECT * FROM best WHERE place <= 3")
def hrw_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rendezvous32(_blocks(spark, sf_dir), _suppliers(spark, sf_dir), 3)


@query("hrw_disruption", f"""WITH {_bids('true')}, a AS (SELECT block, array_to_string(list_sort(list(node)), ',') AS nodes FROM best WHERE place <= 3 GROUP BY block),
{_bids('s_suppkey < (SELECT max(s_suppkey) FROM supplier)', '_less')},
b AS (SELECT block, array_to_string(list_sort(list(node)), ',') AS nodes FROM best_less WHERE place <= 3 GROUP BY block)
SELECT count(*) AS blocks, count(CASE WHEN a.nodes <> b.nodes THEN 1 END) AS moved, round(count(CASE WHEN a.nodes <> b.nodes THEN 1 END) * 1e0 / count(*), 6) AS share FROM a JOIN b ON a.block = b.block""")
def hrw_disruption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose three nodes change when the last of the nodes leaves: about three in the number of nodes."""
    nodes = _suppliers(spark, sf_dir)
    last = nodes.agg(F.max_by("node", "num")).first()[0]
    found = P.disruption32(_blocks(spark, sf_dir), nodes, last, 3)
    return found.select("blocks", "moved", F.round(F.col("moved") / F.col("blocks"), 6).alias("share"))


@query("hrw_place_weighted")
def hrw_place_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every supplier."""
    nodes = _suppliers(spark, sf_dir).select("node", "rack", F.col("num").alias("seed"), (1 + F.col("num") % 3).cast("double").alias("weight"))
    return P.rendezvous64(_blocks(spark, sf_dir), nodes, 3)


_RING = [(f"w{i}", f"rack-{'abc'[i // 4]}") for i in range(NODES)]
_CASES = "(VALUES " + ", ".join(f"({r}, {place}, '{node}')" for r in range(NODES) for place, node in enumerate(P.modulo(_RING, r))) + ") v(r, place, node)"


@query("modulo_place", f"SELECT o_orderkey AS block, place, node FROM orders JOIN {_CASES} ON o_orderkey % {NODES} = r")
def modulo_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.modulo_place(_blocks(spark, sf_dir), _RING)


@query("block_matrix_pivot", """SELECT l_orderkey AS block, """ + ", ".join(f"max(CASE WHEN l_linenumber = {i} THEN l_returnflag ELSE '.' END) AS n{i}" for i in range(1, 8)) + " FROM lineitem GROUP BY l_orderkey")
def block_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by node, a dot where a node has nothing of a block."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), F.concat(F.lit("n"), "l_linenumber").alias("node"), "l_returnflag")
    wide = lines.groupBy("block").pivot("node", [f"n{i}" for i in range(1, 8)]).agg(F.max("l_returnflag"))
    return wide.na.fill(".", [f"n{i}" for i in range(1, 8)])
