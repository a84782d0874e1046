import pytest
from conftest import documents, words
from pyspark.sql import functions as F

import corpus_pipeline as P
from cairnstone.llm import queries


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    toxic, passage = ["idiot moron scum", "scum clown idiot", "moron clown"], " ".join(words(500, 40, 9000))
    plain = [" ".join(words(i, 60, 9000)) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(plain)]
    rows += [(100 + i, plain[i] + " " + toxic[i % 3]) for i in range(30)]
    rows += [(200, plain[0] + " end"), (201, plain[5]), (202, " ".join(words(71, 50, 9000)) + " " + passage), (203, None), (204, "")]
    block = "\n".join(" ".join(words(600 + i, 30, 9000)) for i in range(3))
    rows += [(300, block), (301, " ".join(words(72, 60, 9000)) + "\n" + block)]
    cols = P.COLUMNS
    documents(spark, rows).select(cols).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, left = str(tmp_path), {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, sf), name)
        left[name] = {r["doc_id"] for r in docs.collect()}
        assert name == "bpe" or docs.columns == cols
    assert left["toxicity"] == {i for i, _ in rows if not 100 <= i < 130}
    assert left["line_dedup"] == left["toxicity"]
    assert left["near_duplicates"] == left["line_dedup"] - {200, 201}
    assert left["decontamination"] == left["near_duplicates"] - {202}
    assert left["bpe"] == left["decontamination"]
    cut = P.dedup_lines(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).where("doc_id = 301").first()
    assert "\n" not in cut["text"] and cut["n_chars"] == len(cut["text"])
    out = P.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == left["bpe"]


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null and repeated ids, repeated rows, null and empty texts, a very long text; clean rows all come out."""
    long = " ".join(words(800, 30_000, 9000))
    item = " ".join(words(801, 30, 9000))
    a, b, c = (" ".join(words(802 + i, 60, 9000)) for i in range(3))
    rows = [(None, a), (None, None), (1, None), (1, ""), (2, b), (2, b), (2, c), (3, long), (4, c + " " + item), (4, " ".join(words(806, 60, 9000))), (None, " ".join(words(807, 60, 9000)) + " " + item), (5, b + " end")]
    documents(spark, rows).select(P.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 0), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((repr(r["doc_id"]), r["n_tokens"] > 0) for r in P.run(spark, str(tmp_path)).collect())
    assert got == sorted([("None", True), ("None", False), ("1", False), ("1", False), ("2", True), ("2", True), ("2", True), ("3", True), ("4", True)])


def test_stages_on_empty_documents(spark, empty):
    docs = empty.select(P.COLUMNS)
    for name, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_a_query_for_each_operator(n):
    assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1


def test_predictions_do_not_see_labels(spark):
    from cairnstone.llm import features

    ids = spark.range(1000).select(F.col("id").alias("doc_id"), features.fold(5).alias("f"))
    import zlib

    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in ids.collect())


def test_stages_give_back_what_the_one_before_left_unused(spark, empty):
    beans = list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    collected = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    for name, stage in P.STAGES[1:]:
        before = collected()
        stage(spark, empty.select(P.COLUMNS), "/root/testdata/sf0.001")
        assert collected() > before, name
