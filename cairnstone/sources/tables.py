"""The driver tables, and SQL over them that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..registry import query

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_USED = re.compile(rf"\b({'|'.join(NAMES)})\b(?!\()")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs text with the tables it names bound as parameters: no temporary view is left behind."""
    used = set(_USED.findall(text))
    return spark.sql(_USED.sub(r"{\1}", text.replace("{", "{{").replace("}", "}}")), **{n: table(spark, sf_dir, n) for n in used})


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Registers SQL as a query; oracle is its DuckDB form where the dialects differ."""
    query(name, oracle or text)(lambda spark, sf_dir: run_sql(spark, sf_dir, text))


#: Storage nodes from suppliers: racks are regions.
CLUSTER = """nodes AS (
  SELECT concat('w', s_suppkey) AS id, s_suppkey AS num, r_name AS rack, concat('10.0.', n_nationkey, '.', s_suppkey) AS address,
         CASE WHEN s_suppkey % 20 = 0 THEN 'dead' WHEN s_suppkey % 11 = 0 THEN 'warn' WHEN s_suppkey % 17 = 0 THEN 'decommissioning'
              WHEN s_suppkey % 19 = 0 THEN 'maintenance' ELSE 'healthy' END AS state,
         CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0e0 END AS used, 1e4 + 500 * (s_suppkey % 7) AS capacity,
         CASE WHEN s_suppkey % 20 = 0 THEN 0e0 ELSE s_acctbal * 3 + 4000 END AS read_bps, CASE WHEN s_suppkey % 20 = 0 THEN 0e0 ELSE 1e3 + s_suppkey % 37 END AS write_bps,
         CAST(s_suppkey % 13 AS DOUBLE) AS p99
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: Partitions of the fact table by month: size, reads and writes.
PARTITIONS = """parts AS (
  SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS pid, sum(l_extendedprice) AS size, count(*) AS n_reads, CAST(sum(l_linenumber) AS BIGINT) AS n_writes
  FROM lineitem GROUP BY year(l_shipdate) * 100 + month(l_shipdate))"""

#: Files /region/nation/segment/customer with a length, an age in days, a read count and a policy.
FILES = """files AS (
  SELECT concat('/', lower(replace(r_name, ' ', '-')), '/', lower(replace(n_name, ' ', '-')), '/', lower(c_mktsegment), '/c', c_custkey) AS path,
         lower(replace(r_name, ' ', '-')) AS d1, lower(replace(n_name, ' ', '-')) AS d2, lower(c_mktsegment) AS d3, concat('c', c_custkey) AS name,
         CAST(1000 + c_custkey * 37 % 5000 AS BIGINT) AS len, CAST(c_custkey % 200 AS BIGINT) AS age_days, CAST(c_custkey * 13 % 900 AS BIGINT) AS n_reads,
         CASE c_custkey % 4 WHEN 0 THEN 'replication-3' WHEN 1 THEN 'lrc-6-2-2' WHEN 2 THEN 'rs-6-3' ELSE 'inline' END AS policy,
         CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS degraded
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: Fragments of blocks: blocks are orders, a fragment for each line of one.
FRAGMENTS = """frags AS (
  SELECT l_orderkey AS block, CAST(l_linenumber AS BIGINT) AS idx, concat('w', l_suppkey) AS node, r_name AS rack,
         CASE WHEN l_linenumber <= 2 THEN 'data' WHEN l_linenumber <= 4 THEN 'local' ELSE 'parity' END AS kind,
         CASE WHEN l_returnflag = 'R' THEN 'missing' ELSE 'ok' END AS state
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: Tasks of jobs: a job is an order, a stage a line status and return flag, a task a line.
TASKS = """tasks AS (
  SELECT l_orderkey % 500 AS job, concat(l_returnflag, l_linestatus) AS stage, l_orderkey * 10 + l_linenumber AS task, CAST(l_linenumber AS DOUBLE) * 3 AS start_s,
         l_quantity AS dur_s, l_suppkey % 5 <> 0 AS is_local, CASE WHEN l_tax > 0.07 THEN 'running' ELSE 'done' END AS state
  FROM lineitem)"""
