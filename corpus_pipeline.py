"""Corpus pipeline over documents: toxicity, line dedup, near duplicates, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of documents; other columns of docs,
whatever their names, are left behind. All but the first begin by letting the
executors give back the heap that the stage before has left unused.

A null or empty text is neither toxic nor a duplicate nor contaminated: it stays,
and has no tokens. A null doc_id is kept like any other; it is never labelled, and
of near copies all rows without an id stay. Repeated rows are judged alike, rows of
one doc_id each by their own text. Ties of near copies go to the smallest doc_id.
Texts of any length are read whole, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnstone.llm import bpe, decontaminate, features, line_dedup, ngram_join, toxicity
from cairnstone.llm.shared import load, materialise, shrink
from cairnstone.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Text bytes of a block of BPE: smaller than the operator's own, for the executors come from four other stages.
BLOCK_BYTES = 4 << 20


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxicity.THRESHOLD or more go. The lexicon is learnt from labels outside the held-out fold."""
    ship(spark)
    model = toxicity.fit(docs, load(spark, sf_dir, "labels").where(features.fold(4) != 2))
    return docs.select(COLUMNS).mapInArrow(toxicity.keep_below(spark.sparkContext.broadcast(model)), docs.select(COLUMNS).schema)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; documents stay, n_chars follows the text."""
    ship(spark)
    shrink(spark)
    out = line_dedup.dedup_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays; a text without words is no duplicate."""
    ship(spark)
    shrink(spark)
    return ngram_join.keep_one(docs.select(COLUMNS), 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go."""
    ship(spark)
    shrink(spark)
    return decontaminate.clean(docs.select(COLUMNS), load(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row left."""
    ship(spark)
    shrink(spark)
    return bpe.digest(bpe.encode_and_decode(docs, block_bytes=BLOCK_BYTES))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", tokens),
]
#: Viterbi decoding, randomised bucketing and BPE are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
