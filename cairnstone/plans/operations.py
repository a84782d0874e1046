"""Operators' reports: bytes by worker, restart, membership, listings, cost models. Each query's SQL is written apart from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..registry import query
from ..sources.tables import CLUSTER, FILES, run_sql, table
from .analytics import merkle_buckets

# Fixed values of the cost models: bytes of a block, data and parity fragments, bytes a second of a link and of repair, seconds of one hop.
BLOCK, DATA, PARITY = 134217728, 6, 4
LINK, REPAIR, HOP = 3.1e9, 600e6, 1e-4
FANOUT, ID_BYTES, ROOT_BYTES = 1024, 8, 32


@query("bytes_per_worker", "SELECT 'w' || l_suppkey AS node, count(*) AS copies, CAST(sum(l_orderkey % 1000 + l_linenumber) AS BIGINT) AS size FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey")
def bytes_per_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each worker stores: the lengths of the copies that are there."""
    copies = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    return copies.groupBy(F.concat(F.lit("w"), "l_suppkey").alias("node")).agg(F.count(F.lit(1)).alias("copies"), F.sum(F.col("l_orderkey") % 1000 + F.col("l_linenumber")).cast("long").alias("size"))


@query("restart_summary", """SELECT count(*) AS shards, count(ms) AS ready, max(coalesce(ms, 0)) AS slowest_ms, round(1920000 / (6000e0 + max(coalesce(ms, 0))), 4) AS speedup
FROM (SELECT CASE n_nationkey % 5 WHEN 4 THEN NULL ELSE CAST(n_nationkey * 137 % 900 AS BIGINT) END AS ms FROM nation)""")
def restart_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards are nations; a shard that isn't ready has no time, and counts as 0 for the slowest."""
    ms = F.when(F.col("n_nationkey") % 5 != 4, (F.col("n_nationkey") * 137 % 900).cast("long"))
    slowest = F.max(F.coalesce("ms", F.lit(0)))
    shards = table(spark, sf_dir, "nation").select(ms.alias("ms"))
    return shards.agg(F.count(F.lit(1)).alias("shards"), F.count("ms").alias("ready"), slowest.alias("slowest_ms"), F.round(F.lit(1920000.0) / (6000 + slowest), 4).alias("speedup"))


@query("raft_membership", """WITH m AS (SELECT 'm' || n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN 'leader' WHEN n_nationkey % 4 = 3 THEN 'learner' ELSE 'follower' END AS role, CAST(100000 - n_nationkey * 29 % 50 AS BIGINT) AS applied FROM nation)
SELECT id, role, role <> 'learner' AS voter, (SELECT max(applied) FROM m) - applied AS lag, (SELECT count(*) FROM m WHERE role <> 'learner') AS voters FROM m""")
def raft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members are nations: learners have no vote, and lag is how far a member is behind the furthest."""
    key = F.col("n_nationkey")
    role = F.when(key == 0, "leader").when(key % 4 == 3, "learner").otherwise("follower")
    members = table(spark, sf_dir, "nation").select(F.concat(F.lit("m"), key).alias("id"), role.alias("role"), (100000 - key * 29 % 50).cast("long").alias("applied"))
    all_ = members.agg(F.max("applied").alias("top"), F.count_if(F.col("role") != "learner").alias("voters"))  # one row
    return members.crossJoin(F.broadcast(all_)).select("id", "role", (F.col("role") != "learner").alias("voter"), (F.col("top") - F.col("applied")).alias("lag"), "voters")


def sorted_grid(nodes: DataFrame, key: str, down: bool | None = None) -> DataFrame:
    """nodes in the order of a column, with place: numbers by size, others as text in lower case. Down by default, but for id and rack."""
    down = key not in ("id", "rack") if down is None else down
    by = F.col(key) if dict(nodes.dtypes)[key] != "string" else F.lower(key)
    return nodes.withColumn("place", F.row_number().over(Window.orderBy(by.desc() if down else by.asc(), "id")).cast("long"))


_GRID = "SELECT 'w' || s_suppkey AS id, r_name AS rack, CAST(s_suppkey % 13 AS DOUBLE) AS p99 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("node_grid_sort", f"SELECT 'rack' AS key, id, row_number() OVER (ORDER BY lower(rack), id) AS place FROM ({_GRID}) UNION ALL SELECT 'p99', id, row_number() OVER (ORDER BY p99 DESC, id) FROM ({_GRID})")
def node_grid_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = run_sql(spark, sf_dir, f"WITH {CLUSTER} SELECT id, rack, p99 FROM nodes")
    return sorted_grid(nodes, "rack").select(F.lit("rack").alias("key"), "id", "place").unionByName(sorted_grid(nodes, "p99").select(F.lit("p99").alias("key"), "id", "place"))


def listing(entries: DataFrame, sort: str = "name", reverse: bool = False, limit: int = 1000) -> DataFrame:
    """At most limit entries (name, size, age_days) with place and whether there are more. Size and time go down by default, name goes up."""
    by: Column = {"name": F.col("name"), "size": F.col("size"), "time": -F.col("age_days")}[sort]
    down = (sort != "name") != reverse
    order = [by.desc() if down else by.asc(), F.col("name")]
    shown = entries.orderBy(*order).limit(limit + 1).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return shown.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > limit).where(F.col("place") <= limit)


@query("ls_sorted", """WITH e AS (SELECT 'c' || c_custkey AS name, 1000 + c_custkey * 37 % 5000 AS size FROM customer), r AS (SELECT *, row_number() OVER (ORDER BY size DESC, name) AS place, count(*) OVER () > 1000 AS truncated FROM e)
SELECT name, CAST(size AS BIGINT) AS size, place, truncated FROM r WHERE place <= 1000""")
def ls_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = run_sql(spark, sf_dir, f"WITH {FILES} SELECT name, len AS size, age_days FROM files")
    return listing(files, "size").select("name", "size", "place", "truncated")


@query("du_depth", """WITH f AS (SELECT lower(replace(r_name, ' ', '-')) AS a, lower(replace(n_name, ' ', '-')) AS b, 1000 + c_custkey * 37 % 5000 AS len FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
d AS (SELECT '/' AS path, 0 AS depth, sum(len) AS size FROM f UNION ALL SELECT '/' || a, 1, sum(len) FROM f GROUP BY a UNION ALL SELECT '/' || a || '/' || b, 2, sum(len) FROM f GROUP BY a, b)
SELECT path, CAST(depth AS BIGINT) AS depth, CAST(size AS BIGINT) AS size, row_number() OVER (PARTITION BY depth ORDER BY size DESC, path) AS place FROM d""")
def du_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of folders down to depth 2, the largest of a depth first."""
    files = run_sql(spark, sf_dir, f"WITH {FILES} SELECT d1, d2, len FROM files")
    sums = files.rollup("d1", "d2").agg(F.sum("len").cast("long").alias("size"), F.grouping_id().alias("g"))
    path = F.concat(F.lit("/"), F.concat_ws("/", "d1", "d2"))
    depth = F.when(F.col("g") == 3, 0).when(F.col("g") == 1, 1).otherwise(2).cast("long")
    order = Window.partitionBy("depth").orderBy(F.desc("size"), "path")
    return sums.select(path.alias("path"), depth.alias("depth"), "size").withColumn("place", F.row_number().over(order).cast("long"))


@query("default_rack", "SELECT 'w' || s_suppkey AS id FROM supplier WHERE s_suppkey % 50 = 17")
def default_rack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose rack nobody has set: placement has no failure domain for them."""
    rack = F.when(F.col("s_suppkey") % 50 == 17, "/default-rack").otherwise(F.concat(F.lit("/rack-"), F.col("s_nationkey")))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("w"), "s_suppkey").alias("id"), rack.alias("rack")).where("rack = '/default-rack'").select("id")


@query("split_warning", "SELECT page_id, page_id % 4 = 0 AS unsplittable FROM pages")
def split_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gzip file is read by a single task, whatever it spans."""
    path = F.concat("url", F.when(F.col("page_id") % 4 == 0, "/part.gz").when(F.col("page_id") % 4 == 1, "/gz").otherwise("/part.zst"))
    return table(spark, sf_dir, "pages").select("page_id", path.endswith(".gz").alias("unsplittable"))


@query("thousands", """SELECT o_orderkey, CASE WHEN x < 1000 THEN CAST(x AS VARCHAR) WHEN x < 1000000 THEN concat(x // 1000, ',', lpad(CAST(x % 1000 AS VARCHAR), 3, '0'))
ELSE concat(x // 1000000, ',', lpad(CAST(x // 1000 % 1000 AS VARCHAR), 3, '0'), ',', lpad(CAST(x % 1000 AS VARCHAR), 3, '0')) END AS text FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * (o_orderkey % 97) AS x FROM orders)""")
def thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_number(F.col("o_orderkey") * (F.col("o_orderkey") % 97), 0).alias("text"))


@query("erasure_arithmetic", f"""SELECT p_partkey, greatest(1, CAST(ceil(len / {BLOCK}e0) AS BIGINT)) AS blocks, 7 AS quorum, 3 AS trailing, round(len * 10e0 / 6, 2) AS on_disk, CAST(ceil(least(len, {BLOCK}) / 6e0) AS BIGINT) AS fragment
FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * 9999991 AS len FROM part)""")
def erasure_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six data and four parity fragments: a write is acknowledged at one more than the data fragments, the rest trail."""
    len_ = F.col("p_size").cast("long") * 9999991
    return table(spark, sf_dir, "part").select("p_partkey", F.greatest(F.lit(1), F.ceil(len_ / BLOCK)).cast("long").alias("blocks"), F.lit(DATA + 1).alias("quorum"), F.lit(PARITY - 1).alias("trailing"), F.round(len_ * (DATA + PARITY) / DATA, 2).alias("on_disk"), F.ceil(F.least(len_, F.lit(BLOCK)) / DATA).cast("long").alias("fragment"))


@query("write_latency", f"""SELECT p_partkey, slow, round(1000 * (0.0006 + least(len, 65536) * 3 / {LINK} + greatest(0, len - 65536) / {LINK} + CASE WHEN slow THEN 0.2 ELSE 0 END), 6) AS chain_ms, round(1000 * (0.0002 + len * 7 / 6 / {LINK}), 6) AS dispersal_ms
FROM (SELECT p_partkey, p_partkey % 3 = 0 AS slow, CAST(p_size AS DOUBLE) * 2684354.56 AS len FROM part)""")
def write_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of three passes the first packet on three times and waits for its slowest node; dispersal waits for seven of ten fragments."""
    len_, slow = F.col("p_size").cast("double") * 2684354.56, F.col("p_partkey") % 3 == 0
    packet = F.least(len_, F.lit(65536.0))
    chain = 6 * F.lit(HOP) + packet * 3 / LINK + (len_ - packet) / LINK + F.when(slow, 0.2).otherwise(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", slow.alias("slow"), F.round(1000 * chain, 6).alias("chain_ms"), F.round(1000 * (2 * F.lit(HOP) + len_ * (DATA + 1) / DATA / LINK), 6).alias("dispersal_ms"))


@query("rebuild_time", "SELECT n AS nodes, round(held / 600e6 / 3600, 4) AS chained_h, round(held / ((n - 1) * 600e6) / 3600, 4) AS declustered_h FROM (SELECT s_suppkey + 2 AS n, 1e12 * (50 + s_suppkey % 120) AS held FROM supplier)")
def rebuild_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source against all other nodes at once."""
    n, held = F.col("s_suppkey") + 2, 1e12 * (50 + F.col("s_suppkey") % 120)
    return table(spark, sf_dir, "supplier").select(n.alias("nodes"), F.round(held / REPAIR / 3600, 4).alias("chained_h"), F.round(held / ((n - 1) * REPAIR) / 3600, 4).alias("declustered_h"))


@query("reconcile_wire", f"""WITH ids AS (SELECT DISTINCT l_suppkey % 8 AS worker, l_orderkey AS block, l_linenumber % 5 = 0 AS lost FROM lineitem),
b AS (SELECT worker, block // 16 % 1024 AS bucket, list_sort(list(DISTINCT block)) AS s, coalesce(list_sort(list(DISTINCT block) FILTER (NOT lost)), []) AS r FROM ids GROUP BY ALL)
SELECT worker, count(*) FILTER (s <> r) AS buckets_streamed, {FANOUT} AS buckets, CAST(coalesce(sum(len(r)) FILTER (s <> r), 0) AS BIGINT) * {ID_BYTES} + {ROOT_BYTES} AS bytes FROM b GROUP BY worker""")
def reconcile_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a worker sends: its root, and the ids of buckets whose digests differ."""
    sent = F.coalesce(F.sum(F.when(~F.col("matches"), F.col("n_reported"))), F.lit(0))
    return merkle_buckets(spark, sf_dir).groupBy("worker").agg(F.count_if(~F.col("matches")).alias("buckets_streamed"), F.lit(FANOUT).alias("buckets"), (sent * ID_BYTES + ROOT_BYTES).alias("bytes"))
