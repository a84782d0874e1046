"""Scalar functions as queries over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import formatting as N
from ..registry import query
from ..sources.tables import table

def _up(x: str) -> str:
    """Exact ties go up, as in the Spark form."""
    return f"CASE WHEN ({x}) * 4 = floor(({x}) * 4) THEN ({x}) + 1e-9 ELSE ({x}) END"


_SCALE = "o_totalprice * power(10.0, o_orderkey % 14 - 4)"
_TENS = "CASE WHEN x < 1e3 THEN 0 WHEN x < 1e6 THEN 1 WHEN x < 1e9 THEN 2 WHEN x < 1e12 THEN 3 WHEN x < 1e15 THEN 4 ELSE 5 END"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = F.pow(F.lit(10.0), F.col("o_orderkey") % 14 - 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") * scale).alias("x"))


@query("fmt_bytes", f"""WITH v AS (SELECT o_orderkey, {_SCALE} AS x FROM orders), i AS (SELECT *, {_TENS} AS i FROM v), s AS (SELECT *, x / power(1000.0, i) AS y FROM i)
SELECT o_orderkey, concat(CASE WHEN i = 0 OR y >= 100 THEN printf('%.0f', {_up('y')}) ELSE printf('%.1f', {_up('y')}) END, ' ', list_extract(['B', 'KB', 'MB', 'GB', 'TB', 'PB'], i + 1)) AS text FROM s""")
def fmt_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("o_orderkey", N.bytes_(F.col("x")).alias("text"))


@query("fmt_bibytes", f"""SELECT doc_id, CASE WHEN n_chars < 1024 THEN concat(n_chars, ' B') ELSE printf('%.0f KiB', {_up('n_chars / 1024e0')}) END AS text FROM documents""")
def fmt_bibytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.bibytes(F.col("n_chars").cast("double")).alias("text"))


@query("fmt_count", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice < 1000 THEN CAST(CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS VARCHAR) WHEN l_extendedprice >= 1e5 THEN printf('%.0fk', {_up('l_extendedprice / 1000')}) ELSE printf('%.1fk', {_up('l_extendedprice / 1000')}) END AS text FROM lineitem WHERE l_extendedprice < 1e6""")
def fmt_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_extendedprice < 1e6")
    return rows.select("l_orderkey", "l_linenumber", N.count(F.col("l_extendedprice")).alias("text"))


@query("fmt_duration", f"""WITH v AS (SELECT event_id, value * (event_id % 40) AS s FROM events WHERE value >= 0), r AS (SELECT *, CAST(floor(s + 0.5) AS BIGINT) AS r FROM v)
SELECT event_id, CASE WHEN s < 1 THEN concat(CAST(floor(s * 1000 + 0.5) AS BIGINT), 'ms') WHEN s < 10 THEN printf('%.1fs', {_up('s')}) WHEN r < 60 THEN concat(r, 's')
  WHEN r < 3600 THEN concat(r // 60, 'm', CASE WHEN r % 60 > 0 THEN concat(' ', r % 60, 's') ELSE '' END) ELSE concat(r // 3600, 'h ', r // 60 % 60, 'm') END AS text FROM r""")
def fmt_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value >= 0")
    return rows.select("event_id", N.duration(F.col("value") * (F.col("event_id") % 40)).alias("text"))


@query("fmt_ms", f"SELECT event_id, CASE WHEN value = 0 THEN '0 ms' WHEN value < 10 THEN printf('%.1f ms', {_up('value')}) ELSE concat(CAST(floor(value + 0.5) AS BIGINT), ' ms') END AS text FROM events")
def fmt_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", N.ms(F.col("value")).alias("text"))


@query("parse_size", """SELECT p_partkey, CAST(p_size AS BIGINT) * CAST(power(1024, p_partkey % 5) AS BIGINT) AS size FROM part""")
def parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.element_at(F.array(*[F.lit(u) for u in ("", "KB", " MiB", "GB", "TiB")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", N.parse_size(F.concat(F.col("p_size").cast("string"), units)).alias("size"))


@query("permissions", "SELECT o_orderkey, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'd' ELSE '-' END, " + ", ".join(f"CASE WHEN (o_orderkey % 512) & {1 << (8 - i)} <> 0 THEN '{'rwxrwxrwx'[i]}' ELSE '-' END" for i in range(9)) + ") AS mode FROM orders")
def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", N.permissions(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 512).alias("mode"))


@query("block_names", "SELECT o_orderkey, concat('blk_', lpad(CAST(o_orderkey AS VARCHAR), 16, '0')) AS name FROM orders")
def block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", N.block_name(F.col("o_orderkey")).alias("name"))


@query("path_parts", """SELECT page_id, list_filter(string_split(url, '/'), lambda s: s <> '')[-1] AS leaf, len(list_filter(string_split(url, '/'), lambda s: s <> '')) AS depth,
concat('/', array_to_string(list_filter(string_split(url, '/'), lambda s: s <> '')[1:-2], '/')) AS parent FROM pages""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = N.segments(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(parts, -1).alias("leaf"), F.size(parts).cast("long").alias("depth"), N.parent_of(F.col("url")).alias("parent"))


@query("breadcrumbs", """SELECT page_id, n, concat('/', array_to_string(p[1:n], '/')) AS path FROM (SELECT page_id, p, unnest(range(0, len(p) + 1)) AS n FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda s: s <> '') AS p FROM pages))""")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(N.breadcrumbs(F.col("url"))).alias("n", "path"))
    return rows.select("page_id", F.col("n").cast("long").alias("n"), "path")


@query("escape_html", """SELECT page_id, md5(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest FROM pages""")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.encode(N.escape_html(F.col("html")), "UTF-8")).alias("digest"))


@query("usage_bars", """WITH f AS (SELECT s_suppkey, CAST(floor(least(1, greatest(0, s_acctbal / 10000)) * 128 + 0.5) AS INTEGER) AS e FROM supplier)
SELECT s_suppkey, rpad(concat(repeat('█', e // 8), list_extract(['', '▏', '▎', '▍', '▌', '▋', '▊', '▉'], e % 8 + 1)), 16, ' ') AS bar FROM f""")
def usage_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    return rows.select("s_suppkey", N.bar(F.col("s_acctbal") / 10000, 16).alias("bar"))


@query("sparklines", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders), l AS (SELECT * FROM r WHERE k <= 30),
s AS (SELECT o_custkey, min(o_totalprice) AS low, CASE WHEN max(o_totalprice) > min(o_totalprice) THEN max(o_totalprice) - min(o_totalprice) ELSE 1 END AS span FROM l GROUP BY o_custkey)
SELECT o_custkey, string_agg(substr('▁▂▃▄▅▆▇█', CAST(floor((o_totalprice - low) / span * 7 + 0.5) AS INTEGER) + 1, 1), '' ORDER BY k DESC) AS line FROM l JOIN s USING (o_custkey) GROUP BY o_custkey""")
def sparklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 orders of a customer; only those are gathered."""
    last = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    rows = table(spark, sf_dir, "orders").withColumn("_k", last).where("_k <= 30")
    series = rows.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_k"), "o_totalprice"))), lambda s: s["o_totalprice"]).alias("v"))
    return series.select("o_custkey", N.sparkline(F.col("v")).alias("line"))
