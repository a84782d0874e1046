"""Full-text recall: tokens, relevance and the byte budget.

The index form of a text is lower-cased, without diacritics, split at every
character that is neither letter nor digit. Relevance is BM25 over title,
content and tags with weights 4, 1 and 2; lower is better.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the relevance formula.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WEIGHTS = {"title": 4.0, "content": 1.0, "tags": 2.0}
MARK = "… [truncated; use memory_get]"
_QUERY = re.compile(r"[^\w]+")


class Invalid(ValueError):
    """E0001: an argument out of its range."""


def query_terms(query: str) -> list[str]:
    """Literal terms of a query: runs of letters, digits and underscores."""
    return [t for t in _QUERY.split(query) if t]


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def index_tokens(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text or ""))


def plain_tokens(column: Column) -> Column:
    """Tokens without folding of diacritics, as an expression: for SQL-comparable queries."""
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def folded_tokens(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with an array column <c>_tokens for each of columns, folded exactly."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}_tokens", T.ArrayType(T.StringType())) for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [pa.array([index_tokens(t) for t in batch.column(c).to_pylist()], pa.list_(pa.string())) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *[f"{c}_tokens" for c in columns]])

    return df.mapInArrow(run, schema)


def occurrences(tokens: Column, phrase: list[str]) -> Column:
    """How often the phrase's tokens stand next to each other."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    last = F.size(tokens) - len(phrase)
    same = lambda i: reduce(lambda a, b: a & b, [F.get(tokens, i + k) == w for k, w in enumerate(phrase)])
    return F.when(last < 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), same)))


def ranked(indexed: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """Rows that have every phrase, with a score. indexed: title_tokens, content_tokens and tags_tokens.

    Row count, mean length and document frequencies run over all rows, whatever is filtered later: they are one
    aggregate row, and the rows are read once more."""
    token_columns = [f"{c}_tokens" for c in WEIGHTS]
    # inline() computes the tokens once; a projection alone would be folded into each of their uses.
    once = indexed.select(*[c for c in indexed.columns if c not in token_columns], F.inline(F.array(F.struct(*token_columns))))
    hits = [f"_f{i}" for i in range(len(phrases))]
    tf = [sum((occurrences(F.col(f"{c}_tokens"), p) * w for c, w in WEIGHTS.items()), F.lit(0.0)).alias(h) for p, h in zip(phrases, hits)]
    size = sum((F.size(c) for c in token_columns), F.lit(0)).alias("_len")
    rows = once.select(*[c for c in once.columns if c not in token_columns], size, *tf)
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(h) > 0).alias(f"{h}_df") for h in hits])
    score = F.lit(0.0)
    for h in hits:
        idf = F.log((F.col("_n") - F.col(f"{h}_df") + 0.5) / (F.col(f"{h}_df") + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        score = score - idf * F.col(h) * (K1 + 1) / (F.col(h) + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    found = rows.where(reduce(lambda a, b: a & b, [F.col(h) > 0 for h in hits])).crossJoin(F.broadcast(stats))
    return found.withColumn("score", score).drop("_len", "_n", "_avg", *hits, *[f"{h}_df" for h in hits])


#: Folders that postings are dealt into by term: a query reads those of its terms alone.
INDEX_PARTS = 64


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(INDEX_PARTS)).cast("int")


def append_index(entries: DataFrame, path: str) -> None:
    """Adds entries to the index in path, or makes it. entries: project, key, revision, updated_at, id, deleted, title, content, tags.

    heads has a row for each revision and its length, postings one for each of its terms and the term's weight. Nothing is
    rewritten: a later revision, or a deletion, takes an earlier one's place when the index is read."""
    own = ["project", "key", "revision"]
    rows = folded_tokens(entries.withColumn("tags", F.array_join("tags", " ")), list(WEIGHTS))
    size = sum((F.size(f"{c}_tokens") for c in WEIGHTS), F.lit(0))
    rows.select(*own, "updated_at", "id", "deleted", size.alias("size")).write.mode("append").parquet(f"{path}/heads")
    def weighted(column: str, weight: float) -> Column:
        return F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))

    terms = F.concat(*[weighted(f"{c}_tokens", w) for c, w in WEIGHTS.items()])
    found = rows.where("not deleted").select(*own, F.inline(terms)).groupBy(*own, "term").agg(F.sum("w").alias("f"))
    found.withColumn("part", _part(F.col("term"))).repartition("part").write.mode("append").partitionBy("part").parquet(f"{path}/postings")


def from_index(heads: DataFrame, postings: DataFrame, terms: list[str]) -> DataFrame:
    """Entries that have every term, with a score: one scan of the terms' postings, joined with the entries' heads."""
    terms = list(dict.fromkeys(terms))
    last = heads.groupBy("project", "key").agg(F.max_by(F.struct("revision", "updated_at", "id", "size", "deleted"), "revision").alias("h"))
    last = last.select("project", "key", "h.*").where("not deleted").drop("deleted")
    parts = F.array(*[_part(F.lit(t)) for t in terms])
    hit = postings.where(F.array_contains(parts, F.col("part")) & F.col("term").isin(terms))
    names = [f"_f{i}" for i in range(len(terms))]
    rows = last.join(hit.drop("part"), ["project", "key", "revision"]).groupBy(*last.columns).agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("f"))), F.lit(0.0)).alias(n) for n, t in zip(names, terms)])
    whole = last.agg(F.count(F.lit(1)).alias("_n"), F.avg("size").alias("_avg"))
    seen = rows.agg(*[F.count_if(F.col(n) > 0).alias(f"{n}_df") for n in names])
    score = F.lit(0.0)
    for n in names:
        idf = F.log((F.col("_n") - F.col(f"{n}_df") + 0.5) / (F.col(f"{n}_df") + 0.5))
        score = score - F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * F.col(n) * (K1 + 1) / (F.col(n) + K1 * (1 - B + B * F.col("size") / F.col("_avg")))
    # Two rows of one line each.
    found = rows.where(reduce(lambda a, b: a & b, [F.col(n) > 0 for n in names])).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(seen))
    return found.select("project", "key", "revision", "updated_at", "id", score.alias("score"))


def encoded(entry: dict) -> str:
    return json.dumps(entry, ensure_ascii=False, separators=(",", ":"))


def within_budget(entries: list[dict], limit: int, max_bytes: int) -> dict:
    """The envelope of at most limit entries in max_bytes of JSON; an entry that doesn't fit loses the end of its content.

    entries has up to limit + 1 rows, so this runs on the driver."""
    out, used, cut = [], 2, len(entries) > limit
    for entry in entries[:limit]:
        comma = 1 if out else 0
        room = max_bytes - used - comma
        size = len(encoded(entry).encode())
        if size > room:
            cut, content = True, entry["content"]
            bare = len(encoded(entry | {"content": MARK}).encode())
            if bare > room:
                break
            low, high = 0, len(content)
            while low < high:
                mid = (low + high + 1) // 2
                if bare + len(json.dumps(content[:mid], ensure_ascii=False).encode()) - 2 <= room:
                    low = mid
                else:
                    high = mid - 1
            entry = entry | {"content": content[:low] + MARK}
            size = len(encoded(entry).encode())
        used += size + comma
        out.append(entry)
    return {"memories": out, "truncated": cut, "used_bytes": used, "max_bytes": max_bytes}
