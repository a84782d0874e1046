"""Skew, racks, health, flow, namespace, job and repair queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ordering
from ..registry import query
from ..sources.tables import CLUSTER, FILES, FRAGMENTS, PARTITIONS, TASKS, run_sql, sql_query, table
from . import placed

#: Rows by rank: order statistics are exact elements, never interpolated.
_RANKED = f"{PARTITIONS}, ranked AS (SELECT *, row_number() OVER (ORDER BY size, pid) - 1 AS rk, count(*) OVER () AS n FROM parts)"
_SKEW = f"""{_RANKED}, stats AS (
  SELECT round(sum(size), 2) AS total, max(CASE WHEN rk = CAST(floor(n * 0.5e0) AS BIGINT) THEN size END) AS med,
         max(CASE WHEN rk = CAST(floor(n * 0.99e0) AS BIGINT) THEN size END) AS p99, max(size) AS top, count(*) AS parts FROM ranked)"""

sql_query("skew_report", f"WITH {_SKEW} SELECT total, round(med, 2) AS med, round(p99, 2) AS p99, round(top, 2) AS top, parts, round(top / med, 6) AS ratio, top / med > 10 AS severe FROM stats")
sql_query("skew_top_partitions", f"""WITH {_SKEW}
SELECT pid, concat('dt=', substr(CAST(pid AS VARCHAR(6)), 1, 4), '-', substr(CAST(pid AS VARCHAR(6)), 5, 2)) AS label, round(size, 2) AS size, n_reads, n_writes, round(size / med, 6) AS to_median, size > 8 * med AS hot
FROM parts, stats ORDER BY parts.size DESC, pid LIMIT 5""")
sql_query("over_partitioned", f"WITH {_SKEW} SELECT parts, round(med, 2) AS med, med < 134217728 AND parts > 10 AS over_partitioned FROM stats")
sql_query("access_heat_share", f"""WITH {PARTITIONS}, s AS (
  SELECT pid, n_reads, size, sum(n_reads) OVER (ORDER BY n_reads DESC, pid ROWS UNBOUNDED PRECEDING) AS r, sum(n_reads) OVER () AS rt,
         sum(size) OVER (ORDER BY n_reads DESC, pid ROWS UNBOUNDED PRECEDING) AS b, sum(size) OVER () AS bt FROM parts)
SELECT pid, round(r * 1e0 / rt, 6) AS share_of_reads, round(b / bt, 6) AS share_of_bytes FROM s""")

sql_query("rack_rollup", f"WITH {CLUSTER} SELECT rack, count(*) AS n_nodes, round(sum(used), 2) AS used, round(sum(capacity), 2) AS capacity, round(100 * sum(used) / sum(capacity), 4) AS pct FROM nodes GROUP BY rack")
sql_query("rack_avg_usage", f"WITH {CLUSTER} SELECT rack, round(avg(used / capacity), 6) AS avg_usage FROM nodes GROUP BY rack")
sql_query("df_by_rack_rollup", f"""WITH {CLUSTER}
SELECT coalesce(rack, 'total') AS rack, round(sum(capacity), 2) AS capacity, round(sum(used), 2) AS used, round(sum(capacity) - sum(used), 2) AS free,
       round(100 * sum(used) / sum(capacity), 4) AS pct, count(CASE WHEN state <> 'dead' THEN 1 END) AS live, count(*) AS n_nodes
FROM nodes GROUP BY ROLLUP (rack)""")
sql_query("imbalance_sigma", f"WITH {CLUSTER}, s AS (SELECT coalesce(stddev_pop(used / capacity) * 100, 0e0) AS sigma FROM nodes) SELECT round(sigma, 4) AS sigma, sigma < 10 AS healthy FROM s")
sql_query("cluster_totals", f"""WITH {CLUSTER}
SELECT round(sum(used), 2) AS used, round(sum(capacity), 2) AS capacity, round(sum(CASE WHEN state <> 'dead' THEN capacity ELSE 0e0 END), 2) AS live_capacity,
       round(sum(read_bps), 2) AS read_bps, round(sum(write_bps), 2) AS write_bps, count(DISTINCT rack) AS racks FROM nodes""")

#: Copies of blocks: of a target of three to five, those that are there; a fragment on a node of number 9 fails its checksum.
_HEALTH = f"""{FRAGMENTS}, copies AS (
  SELECT block, 3 + block % 3 AS target, count(CASE WHEN state = 'ok' THEN 1 END) AS left_ok, count(CASE WHEN state = 'ok' AND node LIKE '%9' AND idx = 2 THEN 1 END) AS bad FROM frags GROUP BY block),
classes AS (SELECT block, target, left_ok, CASE WHEN left_ok = 0 THEN 'missing' WHEN bad > 0 THEN 'corrupt' WHEN left_ok = 1 THEN 'critical' WHEN left_ok < target THEN 'under_replicated'
       WHEN left_ok > target THEN 'over_replicated' ELSE 'healthy' END AS health FROM copies)"""
_LINES = "SELECT l_orderkey AS b, 3 + l_orderkey % 3 AS want, sum(CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END) AS have, bool_or(l_returnflag <> 'R' AND l_suppkey % 10 = 9 AND l_linenumber = 2) AS broken FROM lineitem GROUP BY ALL"
_CLASSES = f"""SELECT 'missing' AS health, count(*) FILTER (have = 0) AS n FROM ({_LINES}) UNION ALL SELECT 'corrupt', count(*) FILTER (have > 0 AND broken) FROM ({_LINES})
UNION ALL SELECT 'critical', count(*) FILTER (have = 1 AND NOT broken) FROM ({_LINES}) UNION ALL SELECT 'under_replicated', count(*) FILTER (have > 1 AND have < want AND NOT broken) FROM ({_LINES})
UNION ALL SELECT 'over_replicated', count(*) FILTER (have > want AND NOT broken) FROM ({_LINES}) UNION ALL SELECT 'healthy', count(*) FILTER (have = want AND have > 1 AND NOT broken) FROM ({_LINES})"""
sql_query("health_histogram", f"WITH {_HEALTH} SELECT health, count(*) AS n FROM classes GROUP BY health", f"SELECT * FROM ({_CLASSES}) WHERE n > 0")
sql_query("fsck_counts", f"""WITH {_HEALTH} SELECT count(*) AS checked, count(CASE WHEN health IN ('healthy', 'over_replicated') THEN 1 END) AS healthy,
count(CASE WHEN health IN ('under_replicated', 'critical') THEN 1 END) AS degraded, count(CASE WHEN health = 'corrupt' THEN 1 END) AS corrupt, count(CASE WHEN health = 'missing' THEN 1 END) AS lost FROM classes""",
f"""SELECT count(*) AS checked, count(*) FILTER (have >= want AND have > 1 AND NOT broken) AS healthy, count(*) FILTER (have > 0 AND (have < want OR have = 1) AND NOT broken) AS degraded,
count(*) FILTER (broken AND have > 0) AS corrupt, count(*) FILTER (have = 0) AS lost FROM ({_LINES})""")
_ALERTS = """alerts AS (
  SELECT id, 'danger' AS level, 2 AS rk, 'node is dead' AS message FROM nodes WHERE state = 'dead'
  UNION ALL SELECT id, 'warn', 1, 'over 90 percent full' FROM nodes WHERE used / capacity > 0.9e0
  UNION ALL SELECT id, 'warn', 1, 'slow disks' FROM nodes WHERE p99 >= 12
  UNION ALL SELECT id, 'info', 0, 'nearly empty' FROM nodes WHERE used / capacity < 0.05e0)"""
#: Safe mode: fewer than 999 in 1000 blocks have a copy.
sql_query("cluster_summary", f"""WITH {CLUSTER}, {_HEALTH}, {_ALERTS},
h AS (SELECT count(*) AS total_blocks, count(CASE WHEN health IN ('critical', 'corrupt', 'missing') THEN 1 END) AS at_risk, count(CASE WHEN health = 'under_replicated' THEN 1 END) AS under,
      count(CASE WHEN health = 'missing' THEN 1 END) * 1000 > count(*) AS safe_mode FROM classes),
n AS (SELECT count(*) AS total, count(CASE WHEN state = 'healthy' THEN 1 END) AS healthy_nodes, count(CASE WHEN state = 'dead' THEN 1 END) AS dead_nodes FROM nodes),
a AS (SELECT count(CASE WHEN level <> 'info' THEN 1 END) AS loud FROM alerts)
SELECT total_blocks, at_risk, healthy_nodes, dead_nodes, safe_mode, safe_mode OR total = 0 OR at_risk > 0 OR healthy_nodes < total OR under > 0 OR loud > 0 AS needs_attention FROM h, n, a""",
f"""WITH c AS (SELECT sum(n) AS total, coalesce(sum(n) FILTER (health IN ('critical', 'corrupt', 'missing')), 0) AS risk, coalesce(sum(n) FILTER (health = 'under_replicated'), 0) AS under, coalesce(sum(n) FILTER (health = 'missing'), 0) AS lost FROM ({_CLASSES})),
s AS (SELECT count(*) AS k, count(*) FILTER (s_suppkey % 20 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 17 <> 0 AND s_suppkey % 19 <> 0) AS up, count(*) FILTER (s_suppkey % 20 = 0) AS down,
      count(*) FILTER (s_suppkey % 20 = 0 OR greatest(s_acctbal, 0) > 0.9 * (10000 + 500 * (s_suppkey % 7)) OR s_suppkey % 13 >= 12) AS loud FROM supplier)
SELECT CAST(total AS BIGINT) AS total_blocks, CAST(risk AS BIGINT) AS at_risk, up AS healthy_nodes, down AS dead_nodes, lost * 1000 > total AS safe_mode,
lost * 1000 > total OR k = 0 OR risk > 0 OR up < k OR under > 0 OR loud > 0 AS needs_attention FROM c, s""")
_PRIORITY = "CASE state WHEN 'dead' THEN 4 WHEN 'warn' THEN 3 WHEN 'decommissioning' THEN 2 WHEN 'maintenance' THEN 1 ELSE 0 END"
sql_query("priority_nodes", f"WITH {CLUSTER} SELECT id, state, {_PRIORITY} AS priority, round(used / capacity, 6) AS pct FROM nodes ORDER BY {_PRIORITY} DESC, used / capacity DESC, id LIMIT 6")
sql_query("alerts_ranked", f"""WITH {CLUSTER}, {_ALERTS}
SELECT id, level, message, CAST(row_number() OVER (ORDER BY rk DESC, id, message) AS BIGINT) AS place FROM alerts""")
sql_query("node_search", f"WITH {CLUSTER} SELECT id, rack, address, state FROM nodes WHERE contains(lower(id), 'w1') OR contains(lower(rack), 'asia') OR contains(lower(address), '.7.') OR contains(state, 'warn')")
sql_query("node_list_filter", f"WITH {CLUSTER} SELECT id, rack, state FROM nodes WHERE rack = 'ASIA' AND state <> 'dead'")
sql_query("intensity", f"""WITH {CLUSTER}
SELECT id, round(CASE WHEN state = 'dead' THEN 0e0 WHEN max(read_bps) OVER () > 1 THEN least(1e0, read_bps / max(read_bps) OVER ()) ELSE least(1e0, read_bps) END, 6) AS intensity FROM nodes""")
sql_query("tone", f"WITH {CLUSTER} SELECT id, CASE WHEN used / capacity >= 0.9e0 THEN 'critical' WHEN used / capacity >= 0.75e0 THEN 'warn' ELSE 'ok' END AS tone FROM nodes")
sql_query("rack_pairs", f"WITH {CLUSTER}, r AS (SELECT DISTINCT rack FROM nodes) SELECT a.rack AS a, b.rack AS b FROM r a JOIN r b ON a.rack < b.rack")
sql_query("topology_nodes", f"WITH {CLUSTER} SELECT id, round(10 + 1.9e0 * sqrt(capacity / 1e12), 8) AS size, round(1 + 4 * (read_bps + write_bps) / 2e9, 8) AS width FROM nodes")

_FLOW = "flow AS (SELECT event_type AS source, concat('u', user_id % 7) AS target, sum(value) / 60 AS bps FROM events GROUP BY event_type, user_id % 7)"
sql_query("flow_totals", f"WITH {_FLOW} SELECT source, round(sum(bps), 4) AS bps, count(*) AS targets FROM flow GROUP BY source")
sql_query("flow_union", f"""WITH {CLUSTER}, live AS (SELECT id FROM nodes WHERE state <> 'dead'), k AS (SELECT count(*) AS n FROM live),
totals AS (SELECT 'clients' AS source, sum(read_bps) AS bps FROM nodes UNION ALL SELECT 'writers', sum(write_bps) FROM nodes UNION ALL SELECT 'repair', 0e0 FROM nodes WHERE id = 'w1')
SELECT source, id AS target, round(bps / n, 4) AS bps FROM totals, live, k WHERE bps > 0 AND n > 0""")

sql_query("treemap_rollup", f"""WITH {FILES}
SELECT coalesce(concat('/', d1, coalesce(concat('/', d2), ''), coalesce(concat('/', d3), '')), '/') AS path, count(*) AS n_files, CAST(sum(len) AS BIGINT) AS size, CAST(sum(n_reads) AS BIGINT) AS n_reads
FROM files GROUP BY ROLLUP (d1, d2, d3)""", f"""WITH {FILES}, anc AS (
  SELECT '/' AS path, len, n_reads FROM files UNION ALL SELECT '/' || d1, len, n_reads FROM files UNION ALL SELECT '/' || d1 || '/' || d2, len, n_reads FROM files UNION ALL SELECT '/' || d1 || '/' || d2 || '/' || d3, len, n_reads FROM files)
SELECT path, count(*) AS n_files, CAST(sum(len) AS BIGINT) AS size, CAST(sum(n_reads) AS BIGINT) AS n_reads FROM anc GROUP BY path""")
sql_query("treemap_weighted_age", f"WITH {FILES} SELECT d1, d2, CAST(round(sum(age_days * len) * 1e0 / sum(len)) AS BIGINT) AS age_days, round(least(1e0, (sum(age_days * len) * 1e0 / sum(len)) / 120), 6) AS heat FROM files GROUP BY d1, d2")
sql_query("treemap_depth_cut", f"WITH {FILES} SELECT d1, CAST(sum(len) AS BIGINT) AS size FROM files GROUP BY d1")
sql_query("ls_dirs_first", f"""WITH {FILES}, entries AS (
  SELECT DISTINCT d3 AS name, true AS is_dir FROM files WHERE d1 = 'asia' UNION ALL SELECT name, false FROM files WHERE d1 = 'asia')
SELECT name, is_dir, CAST(row_number() OVER (ORDER BY CASE WHEN is_dir THEN 0 ELSE 1 END, name) AS BIGINT) AS place
FROM (SELECT name, is_dir FROM entries ORDER BY CASE WHEN is_dir THEN 0 ELSE 1 END, name LIMIT 200) shown""")
sql_query("find_files", f"WITH {FILES} SELECT path, len, age_days, policy FROM files WHERE name LIKE 'c1%' AND len > 2000 AND age_days > 30 AND age_days < 150 AND policy = 'replication-3' AND degraded = 1 ORDER BY path LIMIT 100")
sql_query("stat_file", f"WITH {FILES} SELECT path, len, CASE WHEN policy = 'inline' THEN 0 ELSE greatest(1, CAST(ceil(len / 1024e0) AS BIGINT)) END AS blocks, CASE WHEN len % 1024 = 0 THEN 1024 ELSE len % 1024 END AS last_len FROM files")
_FACTOR = "CASE WHEN policy LIKE 'replication-%' THEN CAST(substr(policy, 13) AS DOUBLE) WHEN policy = 'lrc-6-2-2' THEN 10e0 / 6 WHEN policy = 'rs-6-3' THEN 9e0 / 6 ELSE 1e0 END"
sql_query("du_policy", f"""WITH {FILES}, d AS (SELECT d1, sum(len) AS logical, sum(len * {_FACTOR}) AS disk FROM files GROUP BY d1)
SELECT concat('/', d1) AS path, CAST(logical AS BIGINT) AS logical, round(disk, 2) AS on_disk, round(100 * disk / sum(disk) OVER (), 4) AS pct FROM d""")
sql_query("rm_older_than", f"WITH {FILES} SELECT count(*) AS n_files, CAST(sum(len) AS BIGINT) AS size, max(age_days) AS oldest FROM files WHERE age_days > 90")
#: Paths of pages, some of them made odd: absolute, and no segment empty, one dot or two.
_PATHS = "SELECT page_id, concat(CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '/.' WHEN 2 THEN '/a/..' WHEN 3 THEN '/' ELSE '/ok' END, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)) AS path FROM pages"
sql_query("path_predicate", f"SELECT page_id, path, path RLIKE '^(/(?!\\\\.{{1,2}}(/|$))[^/]+)+$' AS valid FROM ({_PATHS}) p",
          f"SELECT page_id, path, starts_with(path, '/') AND len(list_filter(string_split(path[2:], '/'), lambda s: s IN ('', '.', '..'))) = 0 AS valid FROM ({_PATHS})")
sql_query("migrate_globs", f"WITH {FILES} SELECT path FROM files WHERE path LIKE '/asia/%' AND NOT path LIKE '%/building/%'")
sql_query("migration_plan", f"WITH {FILES} SELECT d1, count(*) AS n_files, CAST(sum(len) AS BIGINT) AS size, count(CASE WHEN len < 2000 THEN 1 END) AS small_files, max(len) AS largest FROM files GROUP BY d1")
sql_query("namespace_wide", f"WITH {FILES} SELECT policy, count(*) AS n_files, CAST(sum(len) AS BIGINT) AS size, round(avg(len), 4) AS mean_len FROM files GROUP BY policy")

sql_query("block_split", "SELECT doc_id, n_chars, CAST(idx AS BIGINT) AS idx, CAST(least(1000, n_chars - 1000 * idx) AS BIGINT) AS len FROM (SELECT doc_id, n_chars, explode(sequence(0, CAST(ceil(n_chars / 1000e0) AS BIGINT) - 1)) AS idx FROM documents WHERE n_chars > 350) b",
          "SELECT doc_id, n_chars, CAST(idx AS BIGINT) AS idx, CAST(least(1000, n_chars - 1000 * idx) AS BIGINT) AS len FROM (SELECT doc_id, n_chars, unnest(range(0, CAST(ceil(n_chars / 1000e0) AS BIGINT))) AS idx FROM documents WHERE n_chars > 350) b")
_RANGE = """SELECT doc_id, idx, CAST(greatest(1200, 1000 * idx) - 1000 * idx AS BIGINT) AS skip, CAST(least(2500, n_chars, 1000 * idx + 1000) - greatest(1200, 1000 * idx) AS BIGINT) AS take
FROM {b} WHERE 1000 * idx < least(2500, n_chars) AND 1000 * idx + 1000 > 1200 AND n_chars > 1200"""
sql_query("range_read_chunks", _RANGE.replace("{b}", "(SELECT doc_id, n_chars, explode(sequence(0, CAST(ceil(n_chars / 1000e0) AS BIGINT) - 1)) AS idx FROM documents WHERE n_chars > 0) b"),
          _RANGE.replace("{b}", "(SELECT doc_id, n_chars, unnest(range(0, CAST(ceil(n_chars / 1000e0) AS BIGINT))) AS idx FROM documents WHERE n_chars > 0) b"))
sql_query("block_offsets", f"WITH {FRAGMENTS} SELECT block, idx, CAST(coalesce(sum(100 + idx) OVER (PARTITION BY block ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM frags")
sql_query("one_rack_warning", f"WITH {FRAGMENTS} SELECT block, count(*) AS replicas FROM frags GROUP BY block HAVING count(*) > 1 AND count(DISTINCT rack) < 2")
sql_query("rack_node_sets", f"WITH {FRAGMENTS} SELECT block, rack, concat_ws(',', array_sort(collect_set(node))) AS nodes FROM frags GROUP BY block, rack",
          f"WITH {FRAGMENTS} SELECT block, rack, string_agg(DISTINCT node, ',' ORDER BY node) AS nodes FROM frags GROUP BY block, rack")
sql_query("degraded_blocks", f"WITH {FRAGMENTS} SELECT rack, count(CASE WHEN state <> 'ok' THEN 1 END) AS fragments, count(DISTINCT CASE WHEN state <> 'ok' THEN block END) AS blocks FROM frags GROUP BY rack")
sql_query("fragment_kind_counts", f"""WITH {FRAGMENTS} SELECT block, count(CASE WHEN kind = 'data' THEN 1 END) AS n_data, count(CASE WHEN kind = 'local' THEN 1 END) AS n_local, count(CASE WHEN kind = 'parity' THEN 1 END) AS n_parity
FROM frags GROUP BY block""")
sql_query("fragment_names", f"WITH {FRAGMENTS} SELECT block, idx, concat(substr(kind, 1, 1), row_number() OVER (PARTITION BY block, kind ORDER BY idx) - 1) AS name FROM frags")
sql_query("rack_bands", f"""WITH {CLUSTER}, o AS (SELECT num, rack, CASE WHEN rack = lag(rack) OVER (ORDER BY num) THEN 0 ELSE 1 END AS opens FROM nodes),
b AS (SELECT num, rack, sum(opens) OVER (ORDER BY num ROWS UNBOUNDED PRECEDING) AS band FROM o)
SELECT CAST(band AS BIGINT) AS band, rack, min(num) AS first_node, count(*) AS width FROM b GROUP BY band, rack""")

_ST = f"{TASKS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY job, stage ORDER BY dur_s, task) - 1 AS rk, count(*) OVER (PARTITION BY job, stage) AS n FROM tasks)"
sql_query("job_span", f"WITH {TASKS} SELECT job, greatest(1e0, max(start_s + dur_s)) AS span_s, count(*) AS n_tasks FROM tasks GROUP BY job")
sql_query("job_straggler", f"""WITH {_ST}, s AS (SELECT job, stage, max(CASE WHEN rk = CAST(floor(n * 0.5e0) AS BIGINT) THEN dur_s END) AS med, max(dur_s) AS worst, max(CASE WHEN rk = n - 1 THEN task END) AS task FROM ranked GROUP BY job, stage)
SELECT job, stage, task, worst, med FROM s WHERE med > 0 AND worst > 3 * med""")
sql_query("job_locality", f"WITH {TASKS} SELECT stage, round(avg(CASE WHEN is_local THEN 1e0 ELSE 0e0 END), 6) AS locality, avg(CASE WHEN is_local THEN 1e0 ELSE 0e0 END) < 0.8e0 AS poor FROM tasks GROUP BY stage")
sql_query("stage_progress", f"""WITH {TASKS}, stages AS (SELECT DISTINCT concat(l_returnflag, l_linestatus) AS stage FROM lineitem UNION ALL SELECT 'idle')
SELECT s.stage, count(t.task) AS n_tasks, count(CASE WHEN t.state = 'done' THEN 1 END) AS done FROM stages s LEFT JOIN tasks t ON s.stage = t.stage GROUP BY s.stage""")
_DEPS = "deps AS (SELECT n_nationkey AS stage, n_nationkey - 1 - n_nationkey % 3 AS dep FROM nation WHERE n_nationkey - 1 - n_nationkey % 3 >= 0)"
sql_query("job_dag_depth", f"""WITH RECURSIVE {_DEPS}, walk(stage, depth) AS (
  SELECT n_nationkey, 0 FROM nation UNION ALL SELECT d.stage, w.depth + 1 FROM walk w JOIN deps d ON d.dep = w.stage)
SELECT stage, CAST(max(depth) AS BIGINT) AS depth FROM walk GROUP BY stage""")
sql_query("stage_ready", f"""WITH {_DEPS}, s AS (SELECT n_nationkey AS stage, n_regionkey <> 2 AS complete FROM nation)
SELECT s.stage, coalesce(min(CASE WHEN p.complete THEN 1 ELSE 0 END), 1) = 1 AS started FROM s LEFT JOIN deps d ON s.stage = d.stage LEFT JOIN s p ON d.dep = p.stage GROUP BY s.stage""")

sql_query("repair_eta", f"""WITH {CLUSTER}, {_HEALTH}, h AS (SELECT count(CASE WHEN health <> 'healthy' THEN 1 END) AS d FROM classes),
r AS (SELECT count(CASE WHEN state IN ('healthy', 'warn') THEN 1 END) * 600e6 / (134217728 / 6e0) AS rate, count(*) AS n FROM nodes),
t AS (SELECT t_s FROM (SELECT 0e0 AS t_s UNION ALL SELECT 600e0 UNION ALL SELECT 601e0 UNION ALL SELECT 2520e0) x),
q AS (SELECT t_s, d, rate, n, greatest(0e0, d - rate * greatest(0e0, t_s - 600)) AS queued FROM h, r, t)
SELECT t_s, round(rate, 4) AS rate, round(queued, 2) AS queued, round(queued / rate, 4) AS eta_s, round(CASE WHEN d = 0 THEN 0e0 ELSE (d - queued) / d END, 6) AS progress, greatest(0e0, 600 - t_s) AS grace_s, round(least(queued, 64e0 * n), 2) AS in_flight FROM q""")
sql_query("exposure_share", f"WITH {FRAGMENTS}, t AS (SELECT count(DISTINCT block) AS blocks FROM frags) SELECT node, count(DISTINCT block) AS n, round(count(DISTINCT block) * 1e0 / max(blocks), 8) AS share FROM frags, t GROUP BY node")


@query("repair_priority", """WITH f AS (SELECT l_orderkey AS block, count(*) FILTER (l_returnflag <> 'R') AS left_ok FROM lineitem GROUP BY l_orderkey)
SELECT block, left_ok, 3 + block % 3 AS target, row_number() OVER (ORDER BY left_ok, block) AS place FROM f WHERE left_ok < 3 + block % 3""")
def repair_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair queue: every block below its target, the fewest copies first."""
    rows = run_sql(spark, sf_dir, f"WITH {_HEALTH} SELECT block, left_ok, target FROM copies WHERE left_ok < target")
    # Copies are few, block numbers below 2**40: one key has both.
    return ordering.with_place(rows, F.col("left_ok") * (1 << 40) + F.col("block"), [F.col("left_ok"), F.col("block")])


@query("merkle_buckets", """WITH ids AS (SELECT DISTINCT l_suppkey % 8 AS worker, l_orderkey AS block, l_linenumber % 5 = 0 AS lost FROM lineitem),
both_ AS (SELECT worker, block // 16 % 1024 AS bucket, list_sort(list(DISTINCT block)) AS snapshot, coalesce(list_sort(list(DISTINCT block) FILTER (NOT lost)), []) AS reported FROM ids GROUP BY ALL)
SELECT worker, bucket, CAST(len(snapshot) AS BIGINT) AS n, CAST(len(reported) AS BIGINT) AS n_reported, snapshot = reported AS matches FROM both_""")
def merkle_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per worker, 1024 buckets of block numbers by prefix: the digest of the snapshot's ids against that of the reported ones.

    A digest is the sum of the ids' hashes, so a bucket of any size is a running total and not a list; with the count it
    tells sets apart as a hash of their sorted ids does."""
    ids = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("worker"), F.col("l_orderkey").alias("block")).agg(F.max((F.col("l_linenumber") % 5 != 0).cast("int")).alias("here"))
    digest = F.xxhash64("block").cast("decimal(38,0)")
    found = ids.groupBy("worker", F.floor(F.col("block") / 16).cast("long").alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum("here").alias("m"), F.sum(digest).alias("a"), F.sum(F.when(F.col("here") == 1, digest)).alias("b"))
    found = found.groupBy("worker", (F.col("prefix") % 1024).alias("bucket")).agg(F.sum("n").alias("n"), F.sum("m").alias("n_reported"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return found.select("worker", "bucket", "n", "n_reported", ((F.col("n") == F.col("n_reported")) & F.col("a").eqNullSafe(F.col("b"))).alias("matches"))


@query("expectation_diff", f"""WITH {placed.BIDS}, actual AS (SELECT DISTINCT l_orderkey AS block, concat('w', l_suppkey) AS node FROM lineitem),
e AS (SELECT block, node FROM best WHERE place <= 3)
SELECT block, node, 'absent' AS what FROM (SELECT * FROM e EXCEPT SELECT * FROM actual) UNION ALL SELECT block, node, 'unexpected' FROM (SELECT * FROM actual EXCEPT SELECT * FROM e)""")
def expectation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where placement wants a block against where it is."""
    expected = placed.hrw_place(spark, sf_dir).select("block", "node", F.lit(True).alias("e"))
    actual = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), F.concat(F.lit("w"), "l_suppkey").alias("node")).distinct().withColumn("a", F.lit(True))
    both = expected.join(actual, ["block", "node"], "full").where("e is null or a is null")
    return both.select("block", "node", F.when(F.col("a").isNull(), "absent").otherwise("unexpected").alias("what"))


sql_query("verify_outcome", """WITH s AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0), d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 11 <> 0)
SELECT CASE WHEN d.k IS NULL THEN 'missing' WHEN s.k IS NULL THEN 'extra' WHEN s.v = d.v THEN 'identical' ELSE 'mismatched' END AS outcome, count(*) AS n FROM s FULL OUTER JOIN d ON s.k = d.k
GROUP BY CASE WHEN d.k IS NULL THEN 'missing' WHEN s.k IS NULL THEN 'extra' WHEN s.v = d.v THEN 'identical' ELSE 'mismatched' END""")
sql_query("resume_pending", "SELECT o.o_orderkey FROM orders o LEFT ANTI JOIN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') d ON o.o_orderkey = d.l_orderkey",
          "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey = o_orderkey)")
sql_query("config_diff", """WITH base AS (SELECT n_name AS k, n_regionkey AS v FROM nation), own AS (SELECT n_name AS k, CASE WHEN n_nationkey % 4 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS v FROM nation WHERE n_nationkey % 6 <> 0)
SELECT coalesce(b.k, o.k) AS k, b.v AS default_v, o.v AS own_v, CASE WHEN o.k IS NULL THEN 'default' WHEN b.v = o.v THEN 'same' ELSE 'changed' END AS state FROM base b FULL OUTER JOIN own o ON b.k = o.k""")
sql_query("config_layers", """WITH layers AS (SELECT n_regionkey AS k, n_nationkey % 4 AS layer, n_name AS v FROM nation), r AS (SELECT k, layer, v, row_number() OVER (PARTITION BY k ORDER BY layer DESC, v) AS rk FROM layers)
SELECT k, v, CASE layer WHEN 0 THEN 'defaults' WHEN 1 THEN 'file' WHEN 2 THEN 'flag' ELSE 'env' END AS source FROM r WHERE rk = 1""")
sql_query("snapshot_asof", """WITH probes AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id),
r AS (SELECT e.user_id, e.event_type, e.value, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts DESC, e.event_id DESC) AS rk FROM events e JOIN probes p ON e.user_id = p.user_id WHERE e.ts <= p.t - INTERVAL '42' HOUR)
SELECT user_id, event_type, value FROM r WHERE rk = 1""")
sql_query("wordcount", "SELECT word, count(*) AS n FROM (SELECT explode(split(text, '[ \\n]+')) AS word FROM documents) w WHERE word <> '' GROUP BY word".replace("\\n", "\\\\n"),
          "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM documents) w WHERE word <> '' GROUP BY word")
sql_query("avg_by_group", "SELECT l_linenumber, round(avg(l_extendedprice), 4) AS mean_price, count(*) AS n FROM lineitem GROUP BY l_linenumber")


@query("global_sort", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def global_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.with_place(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")])


sql_query("read_path_ratios", """WITH c AS (SELECT count(CASE WHEN event_type = 'view' THEN 1 END) AS lease, count(CASE WHEN event_type = 'click' THEN 1 END) AS resolve, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS master FROM events)
SELECT lease, resolve, master, round(100e0 * lease / (lease + resolve + master), 1) AS lease_pct FROM c""")
sql_query("quorum_ack_time", "WITH a AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS k FROM lineitem) SELECT l_orderkey, l_quantity AS ack FROM a WHERE k = 3")
sql_query("hedged_latency", "SELECT l_orderkey, l_linenumber, least(l_quantity, 10e0 + l_tax * 100) AS latency FROM lineitem")
sql_query("rolling_series", """SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS sum24,
       count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n30 FROM events""")
sql_query("liveness_gaps", """WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT user_id, count(*) AS deaths FROM g WHERE nxt >= ts + INTERVAL '90' MINUTE GROUP BY user_id""")
sql_query("flow_window_60s", "SELECT event_type, CAST(date_trunc('MINUTE', ts) AS TIMESTAMP_NTZ) AS minute, round(sum(value) / 60, 6) AS bps FROM events GROUP BY event_type, date_trunc('MINUTE', ts)",
          "SELECT event_type, date_trunc('minute', ts) AS minute, round(sum(value) / 60, 6) AS bps FROM events GROUP BY event_type, date_trunc('minute', ts)")
sql_query("external_sql", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type")
sql_query("events_json", "SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY CAST(get_json_object(props, '$.k') AS BIGINT)",
          "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
