"""Line dedup by winnowing, in DataFrame expressions only.

A document is its lines (split at newlines). In every run of `run` consecutive
lines the least line hash is a fingerprint of the run (winnowing); neighbouring
runs mostly share theirs, and a fingerprint is one row with the place of its line.
Equal runs share a fingerprint, so only those that stand at two places or more go
on: their positions are joined, and from each the match is extended both ways,
over all runs around its line that the fingerprint stands for. Runs meet by
(fingerprint, content) with their first place, by doc_id, then line. A line goes
if a run that covers it has an earlier first place; overlapping runs merge into
the maximal repeated stretch. Only minima are aggregated, so a run that a third of
all documents share is a row for each document and never a pair; joins with
fingerprints and first places are dealt over SALTS tasks for each key.

A null text has no lines and stays null; an empty text is one empty line. Texts
of fewer lines than `run` lose none. A null doc_id comes after all others. Rows
with equal doc_id and text are one document: all keep the same lines. Empty
tables give empty results. Texts of any length are read whole. Other columns pass
through unchanged; a column named n_lines or n_removed, or like one of the
operator's own, raises ValueError.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import load, materialise

RUN = 3
#: Tasks that the rows of one fingerprint, or of one run, are dealt over.
SALTS = 8


def repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, version, at) of each run that has an earlier first place. docs: doc_id, version (hash of the text), lines."""
    rows = docs.where(F.size("lines") >= run).select("doc_id", "version", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.hash(x)).alias("g"))

    def at(column: str, i: F.Column) -> list[F.Column]:
        return [F.element_at(F.col(column), (i + F.lit(k + 1)).cast("int")) for k in range(run)]

    def describe(i: F.Column) -> F.Column:
        h = at("h", i)
        least = F.least(*h) if run > 1 else h[0]
        where = reduce(lambda rest, k: F.when(h[k] == least, F.lit(k)).otherwise(rest), range(run - 2, -1, -1), F.lit(run - 1))
        return F.struct(i.cast("int").alias("at"), (i + where).cast("int").alias("line"), least.alias("print"), F.xxhash64(*h).alias("k1"), F.hash(*at("g", i)).alias("k2"))

    def around(r: F.Column) -> F.Column:
        same = F.filter(F.slice("runs", r["at"] + 1, run), lambda x: x["line"] == r["line"])
        return F.struct(r["print"].alias("print"), r["line"].alias("line"), F.transform(same, lambda x: F.struct(x["at"].alias("at"), x["k1"].alias("k1"), x["k2"].alias("k2"))).alias("around"))

    runs = rows.select("doc_id", "version", F.transform(F.sequence(F.lit(0), F.size("h") - F.lit(run)), describe).alias("runs"))
    # Runs of one fingerprint are neighbours; the first of them stands for all.
    first_of = F.filter("runs", lambda r, j: (j == 0) | (F.get("runs", j - 1)["line"] != r["line"]))
    prints = materialise(runs.select("doc_id", "version", F.inline(F.transform(first_of, around))), "prints")
    salt = F.pmod(F.xxhash64("doc_id", "version"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")

    def place(line: str) -> F.Column:
        return F.struct(F.col("doc_id").isNull(), "doc_id", "version", line)

    seeds = prints.groupBy("print").agg(F.min(place("line")).alias("a"), F.max(place("line")).alias("b")).where("a < b").select("print", salts)
    near = prints.withColumn("salt", salt).join(seeds, ["print", "salt"], "left_semi").select("doc_id", "version", "salt", "print", F.inline("around"))
    first = near.groupBy("print", "k1", "k2").agg(F.min(place("at")).alias("a"), F.max(place("at")).alias("b")).where("a < b").select("print", "k1", "k2", F.col("a").alias("first"), salts)
    return near.join(first, ["print", "k1", "k2", "salt"]).where(place("at") > F.col("first")).select("doc_id", "version", "at")


def dedup_lines(docs: DataFrame, run: int = RUN, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines left in text, and n_lines, n_removed (long)."""
    if clash := [c for c in docs.columns if c.lower() in {"n_lines", "n_removed", "_version", "_lines", "_gone", "_id", "_v"}]:
        raise ValueError(f"columns already there: {clash}")
    own = docs.withColumn("_version", F.xxhash64(F.col(text)))
    lines = F.split(F.col(text), "\n", -1)
    found = repeated_runs(own.select(F.col(id).alias("doc_id"), F.col("_version").alias("version"), lines.alias("lines")), run)
    gone = found.groupBy("doc_id", "version").agg(F.collect_set("at").alias("_gone")).select(F.col("doc_id").alias("_id"), F.col("version").alias("_v"), "_gone")
    joined = own.join(gone, own[id].eqNullSafe(gone["_id"]) & (own["_version"] == gone["_v"]), "left").withColumn("_lines", lines)
    covered = F.flatten(F.transform("_gone", lambda i: F.sequence(i, i + F.lit(run - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered)
    kept = F.array_join(F.transform(left, lambda i: F.element_at(F.col("_lines"), (i + 1).cast("int"))), "\n")
    total = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long")
    changed = F.col("_gone").isNotNull()
    new = {text: F.when(changed, kept).otherwise(F.col(text)), "n_lines": total, "n_removed": F.when(changed, F.size("_lines") - F.size(left)).otherwise(F.lit(0)).cast("long")}
    return joined.select(*[new[c].alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], new["n_lines"].alias("n_lines"), new["n_removed"].alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT doc_id, a, unnest(range(0, len(a) - 2)) AS p FROM l WHERE len(a) >= 3
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY a[p + 1], a[p + 2], a[p + 3] ORDER BY doc_id NULLS LAST, p) AS n FROM s
), g AS (
  SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS i FROM r WHERE n > 1
), x AS (
  SELECT doc_id, unnest(a) AS line, unnest(range(0, len(a))) AS i FROM l
), k AS (
  SELECT x.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY x.i) AS kept
  FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
