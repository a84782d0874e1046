"""Classifiers by held-out accuracy and by cases of their own."""

import numpy as np
import pytest
from conftest import documents

from cairnstone.llm import features, langid, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def joined(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")


def test_language_of_held_out_rows(spark):
    out = langid.op7_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97


def test_language_edges(spark, edge, empty):
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in langid.predict(edge, None).collect())
    train = documents(spark, [(i, ("the cat and the dog " if i % 2 == 0 else "le chat et le chien ") * (1 + i % 3)) for i in range(40)])
    model = langid.fit(train)
    rows = documents(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the cat and the dog"), (5, "le chat et le chien"), (5, "le chat et le chien"), (6, "ζζζ ωωω ψψψ ξξξ")])
    got = {r["doc_id"]: r for r in langid.predict(rows, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["und", "und", "und", "en", "fr"]
    assert got[6]["rejected"] and not got[4]["rejected"] and langid.predict(empty, model).count() == 0
    assert langid.fit(train.limit(0)) is None


def test_rows_of_one_id_are_one_sampled_row(spark):
    docs = documents(spark, [(1, f"text {i}") for i in range(300)] + [(1, None), (2, "other"), (None, "none")])
    sample = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, y int")
    assert sorted(map(tuple, features.texts_of(docs, sample).collect())) == [(0, "other"), (1, "text 0")]


def test_grams_stay_in_their_text():
    import pyarrow as pa

    texts = ["abc", "", None, "de", "abc"]
    all_ = features.counts(pa.array(texts), features.LETTERS)
    for i, t in enumerate(texts):
        assert (all_[i] == features.counts(pa.array([t], pa.string()), features.LETTERS)[0]).all()


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def test_quality_of_held_out_rows(spark, joined):
    out = quality.op10_quality(spark, SF).where("held_out").join(joined.select("doc_id", "quality"), "doc_id").collect()
    assert auc([r["quality"] for r in out], [r["score"] for r in out]) > 0.8


def test_quality_edges(spark, edge, empty):
    assert {r["score"] for r in quality.score(edge, None).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(edge, labels)
    assert all(0 <= r["score"] <= 1 for r in quality.score(edge, model).collect()) and quality.score(empty, model).count() == 0
    assert quality.fit(edge, labels.limit(0)) is None


def test_neighbours_are_exact():
    rng = np.random.default_rng(1)
    count = rng.poisson(0.05, (30, features.DIMS)).astype(np.float32)
    idf = np.ones(features.DIMS, np.float32)
    basis = quality.truncated_svd(features.tfidf(count, idf), 8)
    points = quality.unit(features.tfidf(count, idf) @ basis)
    y = rng.integers(0, 2, 30).astype(float)
    m = quality.Model(idf, basis, points, y, np.ones(30), 0.5)
    for i, z in enumerate(m.latent(count)):
        best = np.argsort(-(points @ z))[:5]
        w = np.maximum(points[best] @ z, 1e-6).astype(float) ** quality.SHARPNESS
        assert m.score(count, 5)[i] == pytest.approx((w * y[best]).sum() / w.sum(), rel=1e-4)


def test_toxicity_of_held_out_rows(spark, joined):
    out = toxicity.op8_toxicity(spark, SF).where("held_out").join(joined.select("doc_id", "toxic"), "doc_id").collect()
    y, p = np.array([r["toxic"] for r in out]), np.array([r["predicted"] for r in out])
    assert (y == p).mean() > 0.9 and p[y == 0].mean() < 0.05


@pytest.fixture(scope="module")
def reader(spark):
    source = toxicity.source_model(spark.read.parquet(f"{SF}/documents.parquet"))
    return toxicity.Reader(dict.fromkeys(["idiot", "moron", "clown", "scum", "pathetic", "stupid", "loser", "trash"], 6.0), -4.0, source)


@pytest.mark.parametrize("text", ["you-1d10t", "you-idiot", "dumb.1d10t", "x/m0r0n", "you,$cum", "what~a~l0ser", "a.b.c.d.e.i.d.i.o.t", "so_st-up1d", "-".join(["plain"] * 400 + ["1d10t"])])
def test_words_behind_separators(reader, text):
    assert reader.score(text) > 0.5


def test_long_tokens_take_linear_time(reader):
    import time

    start = time.perf_counter()
    reader.score(".".join(["1d10t"] * 3000))
    reader.score(".-" * 50_000 + "1" * 50_000)
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("text", ["idiot", "1d10t", "id!ot", "m0r0n", "cl0wn", "$cum", "p4thet1c", "l0ser", "iddiiot", "i.d.i.o.t", "s t u p i d", "loooser", "tr@sh", "(idiot)", "what 5tup1d words", "y o u i d i o t"])
def test_restored(reader, text):
    assert reader.score(text) > 0.3


@pytest.mark.parametrize("text", ["!diot", "|oser", "+rash", "(lown", "<lown", "{lown", "¢lown", "£oser", "stup!d", "idio+", "\"!diot\",", "(!diot)", "(!d!o+)", "idio+!!", "what |0ser", "!!diot", "...+ra$h..."])
def test_restored_at_the_edges(reader, text):
    assert reader.score(text) > 0.3


@pytest.mark.parametrize("c", sorted(toxicity.LOOKALIKES))
def test_skeletons_of_look_alikes(c):
    assert {toxicity.skeleton(x) for x in toxicity.LOOKALIKES[c]} == {toxicity.skeleton(c)}


@pytest.mark.parametrize("text", ["!", "(the thing)", "<|>" * 20_000, "+ the + thing !", "€100 (10%)"])
def test_signs_are_left_alone(reader, text):
    assert reader.score(text) < 0.3


@pytest.mark.parametrize("text", ["", None, "the thing is here", "12345", "a b c d e", "...", "10 t 20"])
def test_left_alone(reader, text):
    assert reader.score(text) < 0.3


def test_viterbi_is_the_best_of_all_readings(reader):
    import itertools

    def cost(word):
        a = b = 0
        p = 0.0
        for c in word + " ":
            z = toxicity.symbol(c)
            p += reader.model[a, b, z]
            a, b = b, z
        return p

    for word in ("1d10t", "$t00p", "th!ng"):
        options = toxicity.lattice(word)
        best = max(itertools.product(*options), key=lambda r: sum(c for _, c in r) + cost("".join(x for x, _ in r)))
        assert toxicity.viterbi(options, reader.model) == "".join(x for x, _ in best)


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(12)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(edge, model).collect()) and toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(edge, labels.limit(0))
    assert {round(r["score"], 3) for r in toxicity.score(edge, nothing).collect()} == {0.018}
