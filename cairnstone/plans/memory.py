"""Recall, history and revision queries over documents, conversations and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from ..operators import store
from ..registry import query
from ..sources.tables import sql_query, table

QUERY, PROJECT, LIMIT = "the and", "src0", 10


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries: the source is the project, the first six words the title, the language the tag."""
    d = table(spark, sf_dir, "documents")
    title = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 6), " ")
    return d.select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("key"), title.alias("title"), F.coalesce("text", F.lit("")).alias("content"), F.lit("note").alias("kind"), F.array("lang").alias("tags"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("revision"), (F.col("doc_id") % 97 * 1000).alias("created_at"), (F.col("doc_id") % 97 * 1000).alias("updated_at"), F.col("doc_id").alias("id"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    return e.withColumn("title_tokens", X.plain_tokens(F.col("title"))).withColumn("content_tokens", X.plain_tokens(F.col("content"))).withColumn("tags_tokens", X.plain_tokens(F.array_join("tags", " ")))


_TOK = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_DOCS = """d AS (SELECT doc_id, source, doc_id % 97 * 1000 AS updated_at, array_to_string(string_split(coalesce(text, ''), ' ')[1:6], ' ') AS title, coalesce(text, '') AS content, lang FROM documents),
k AS (SELECT doc_id, source, updated_at, """ + _TOK.replace("{c}", "title") + " AS a, " + _TOK.replace("{c}", "content") + " AS b, " + _TOK.replace("{c}", "lang") + " AS c FROM d)"
_TERM = "len(list_filter(a, lambda t: t = '{w}')) * 4.0 + len(list_filter(b, lambda t: t = '{w}')) * 1.0 + len(list_filter(c, lambda t: t = '{w}')) * 2.0"
_SCORE = "- greatest_idf({i}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / av))"
_IDF = "(CASE WHEN ln((nn - d{i} + 0.5) / (d{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((nn - d{i} + 0.5) / (d{i} + 0.5)) END)"


def _recall_sql() -> str:
    words = X.query_terms(QUERY)
    f = ", ".join(f"CAST({_TERM.replace('{w}', w)} AS DOUBLE) AS f{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(words)))
    score = " ".join(_SCORE.replace("greatest_idf({i})", _IDF).replace("{i}", str(i)) for i in range(len(words)))
    return f"""WITH {_DOCS}, f AS (SELECT *, len(a) + len(b) + len(c) AS n, {f} FROM k), s AS (SELECT count(*) AS nn, avg(n) AS av, {df} FROM f)
SELECT CAST(doc_id AS VARCHAR) AS key, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9), updated_at DESC, doc_id DESC) AS INTEGER) AS place
FROM (SELECT *, 0.0 {score} AS score FROM f, s WHERE {' AND '.join(f'f{i} > 0' for i in range(len(words)))} AND source = '{PROJECT}') ORDER BY round(score, 9), updated_at DESC, doc_id DESC LIMIT {LIMIT + 1}"""


@query("recall_bm25", _recall_sql())
def recall_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.ranked(_indexed(spark, sf_dir), [[t] for t in X.query_terms(QUERY)]).where(F.col("project") == PROJECT)
    order = [F.round("score", 9), F.desc("updated_at"), F.desc("id")]
    top = found.select("key", "score", "updated_at", "id").orderBy(*order).limit(LIMIT + 1)
    return top.select("key", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(*order)).alias("place"))


_indexes: dict[tuple[str, str], str] = {}


def _index_sql() -> str:
    return _recall_sql().replace("lower(title)", "strip_accents(lower(title))").replace("lower(content)", "strip_accents(lower(content))").replace("lower(lang)", "strip_accents(lower(lang))")


@query("recall_postings", _index_sql())
def recall_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As recall_bm25, with the index's own tokens, over an index that is written once for each application and table."""
    own = (spark.sparkContext.applicationId, sf_dir)
    if own not in _indexes:
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/cairnstone-index-{uuid.uuid4().hex}"
        X.append_index(entries(spark, sf_dir).withColumn("deleted", F.lit(False)), path)
        _indexes[own] = path
    path = _indexes[own]
    found = X.from_index(spark.read.parquet(f"{path}/heads"), spark.read.parquet(f"{path}/postings"), [t for q in X.query_terms(QUERY) for t in X.index_tokens(q)])
    order = [F.round("score", 9), F.desc("updated_at"), F.desc("id")]
    top = found.where(F.col("project") == PROJECT).orderBy(*order).limit(LIMIT + 1)
    return top.select("key", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(*order)).alias("place"))


sql_query("recall_recent", "SELECT doc_id, doc_id % 97 * 1000 AS updated_at FROM documents WHERE source = 'src0' ORDER BY doc_id % 97 * 1000 DESC, doc_id DESC LIMIT 11")
sql_query("memory_get", "SELECT doc_id, text, lang FROM documents WHERE source = 'src3' AND doc_id = (SELECT min(doc_id) FROM documents WHERE source = 'src3')")
sql_query("memory_history_topn", """SELECT conv_id, turn, role, rk FROM (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS rk FROM conversations) h WHERE rk <= 3""")
sql_query("memory_revision_heads", "SELECT conv_id, max(turn + 1) AS revision, count(*) AS n FROM conversations GROUP BY conv_id")
sql_query("memory_revisions", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS revision FROM events")


@query("recall_budget")
def recall_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope that a caller with 16 000 bytes gets: eleven rows come to the driver."""
    top = entries(spark, sf_dir).where(F.col("project") == PROJECT).orderBy(F.desc("updated_at"), F.desc("id")).limit(LIMIT + 1)
    out = X.within_budget([{f: r[f] for f in store.FIELDS} for r in top.collect()], LIMIT, 16000)
    rows = [(m["key"], len(m["content"]), out["truncated"], out["used_bytes"]) for m in out["memories"]]
    return spark.createDataFrame(rows, "key string, n_chars long, truncated boolean, used_bytes long")


_FOLD = """WITH RECURSIVE r AS (SELECT user_id, event_type = 'error' AS del, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
q AS (SELECT user_id, del, seq, CASE WHEN event_id % 5 = 0 THEN 99 ELSE seq - 1 END AS expected FROM r),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS head, CAST(0 AS BIGINT) AS now, false AS ok FROM events
UNION ALL SELECT user_id, seq, CASE WHEN good AND NOT del THEN head + 1 ELSE head END, CASE WHEN NOT good THEN now WHEN del THEN 0 ELSE head + 1 END, good
FROM (SELECT q.user_id, q.seq, q.del, f.head, f.now, q.expected = f.now AND (NOT q.del OR f.now > 0) AS good FROM f JOIN q ON q.user_id = f.user_id AND q.seq = f.seq + 1))
SELECT 'p' AS project, CAST(user_id AS VARCHAR) AS key, seq, ok, now AS revision FROM f WHERE seq > 0"""


@query("memory_cas_fold", _FOLD)
def memory_cas_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as writes: a key is a user, an error deletes, every fifth write expects a stale revision."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seq = F.row_number().over(w).cast("long")
    requests = e.select(F.lit("p").alias("project"), F.col("user_id").cast("string").alias("key"), seq.alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.when(F.col("event_id") % 5 == 0, 99).otherwise(seq - 1).cast("long").alias("expected"))
    return store.fold_commits(requests)


_VALID = "SELECT doc_id, CASE WHEN trim(source) = '' THEN 'blank' WHEN {bytes}(source) > 200 THEN 'too long' END AS project_error, CASE WHEN trim(text) = '' THEN 'blank' WHEN {bytes}(text) > 65536 THEN 'too long' END AS content_error, {bytes}(text) AS n_bytes FROM documents"


@query("memory_validation", _VALID.replace("{bytes}(text) AS", "CAST(strlen(text) AS INTEGER) AS").replace("{bytes}", "strlen"))
def memory_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", store.invalid_reason("source", 200).alias("project_error"), store.invalid_reason("text", 65536).alias("content_error"), F.octet_length("text").alias("n_bytes"))


_POSTINGS = f"WITH {_DOCS}, p AS (SELECT doc_id, 'title' AS field, unnest(a) AS term FROM k UNION ALL SELECT doc_id, 'content', unnest(b) FROM k UNION ALL SELECT doc_id, 'tags', unnest(c) FROM k) SELECT doc_id, field, term, count(*) AS tf FROM p GROUP BY ALL"


@query("postings", _POSTINGS)
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index as a table."""
    i = _indexed(spark, sf_dir).select(F.col("id").alias("doc_id"), "title_tokens", "content_tokens", "tags_tokens")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_tokens").alias("terms")) for f in ("title", "content", "tags")])
    long = i.select("doc_id", F.explode(fields).alias("x")).select("doc_id", "x.field", F.explode("x.terms").alias("term"))
    return long.groupBy("doc_id", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


_STATS = f"WITH {_DOCS}, t AS (SELECT doc_id, len(a) + len(b) + len(c) AS n FROM k) SELECT count(*) AS n_rows, round(avg(n), 6) AS mean_length FROM t"


@query("corpus_statistics", _STATS)
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("title_tokens") + F.size("content_tokens") + F.size("tags_tokens")
    return _indexed(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(n), 6).alias("mean_length"))
