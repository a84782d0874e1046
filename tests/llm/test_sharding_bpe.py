import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import words
from pyspark.sql import functions as F

from cairnstone.llm import bpe, kernels, sharding


def test_every_record_has_one_place(spark, edge, edge_rows):
    out = sharding.shard(edge, 5, bucket_bytes=20_000).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in out) == sorted(map(repr, edge_rows))
    slots = [sorted(r["slot"] for r in out if r["shard"] == s) for s in range(5)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_the_shuffle_repeats_and_depends_on_its_seed(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    a, b, c = ([tuple(r) for r in sharding.shard(d, 4, seed=s).select("doc_id", "shard", "slot").orderBy("doc_id").collect()] for d, s in ((df, 1), (df.orderBy(F.desc("doc_id")), 1), (df, 2)))
    assert a == b != c
    order = [r[0] for r in sorted(a, key=lambda r: (r[1], r[2]))]
    assert abs(np.corrcoef(order, range(500))[0, 1]) < 0.2


def test_repeated_rows_are_scattered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 50)
    df = spark.createDataFrame([(1, "the same row")] * 900 + [(i, f"text {i}") for i in range(100)] + [(None, None)] * 60, "doc_id long, text string")
    parts = sharding.scatter_and_shuffle(df, 42, 1500)
    held = {r["_bucket"]: r["count"] for r in parts.where("doc_id = 1").groupBy("_bucket").count().collect()}
    assert sum(held.values()) == 901 and max(held.values()) < 150
    out = sharding.shard(df, 7, bucket_bytes=1500).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in out) == sorted(repr(tuple(r)) for r in df.collect())
    for k in range(7):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))


def brute_shards(rows, n_shards, seed):
    """Both passes of one bucket, by hand: order by record hash, Fisher-Yates, dealt round."""
    order = sharding.fisher_yates(len(rows), seed * 1_000_003)
    ranked = [r for _, r in sorted(rows, key=lambda x: x[0])]
    return {ranked[int(i)]: (p % n_shards, p // n_shards) for p, i in enumerate(order)}


def test_shards_by_hand(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    hashed = df.select("doc_id", F.xxhash64(F.lit(42), F.col("doc_id").cast("string"), F.col("text")).alias("h")).collect()
    want = brute_shards([(r["h"], r["doc_id"]) for r in hashed], 24, 42)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(df).collect()} == want


def test_fisher_yates_reaches_every_order():
    assert len({tuple(sharding.fisher_yates(4, s)) for s in range(600)}) == 24
    assert sharding.fisher_yates(0, 1).tolist() == [] and sharding.fisher_yates(1, 1).tolist() == [0]


def test_written_shards_read_back(spark, edge, tmp_path):
    out = sharding.shard(edge, 3)
    sharding.write_shards(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("shard").count().count() == 3 and back.count() == edge.count()


def test_clashing_columns_and_empty_tables(spark, edge, empty):
    with pytest.raises(ValueError):
        sharding.shard(edge.withColumn("Slot", F.lit(1)))
    assert sharding.shard(empty).count() == 0


def test_shard_query(spark):
    sf = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in sharding.op2_shard(spark, sf).collect():
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "rows")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(bpe.tokenizer_json())


def check(df, texts, tokenizer, **options):
    got = {r["doc_id"]: r for r in bpe.encode_and_decode(df, **options).collect()}
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert bytes(got[i]["ids"]) == np.array(ids, "<u4").tobytes() and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False) == (t or "")


def test_bpe_is_the_library_s(spark, edge, edge_rows, tokenizer):
    check(edge, {i: t for i, t in edge_rows if i is not None}, tokenizer)


@pytest.mark.parametrize("block_bytes, buckets", [(1, 1), (300, 7), (1 << 20, 1 << 16), (1 << 20, None)])
def test_bpe_on_odd_texts(spark, tokenizer, block_bytes, buckets):
    r = random.Random(3)
    parts = ["a", "B", "é", "'s", "'ll", "'", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "᠎", "​", "1", "²", "½", "<|endoftext|>", "<|", "🦣", "日本", "́", "...", "\x00", "　", " "]
    texts = {i: "".join(r.choice(parts) for _ in range(r.randrange(40))) for i in range(400)}
    check(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts, tokenizer, block_bytes=block_bytes, buckets=buckets)


def test_words_are_the_tokenizer_s():
    """Against the tokenizer's pattern, read by a regular expression."""
    import regex

    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|[{space}]+(?![^{space}])|[{space}]+")
    r = random.Random(8)
    parts = ["a", "B", "é", "s", "t", "re", "ve", "l", "ll", "d", "m", "'", "'", " ", " ", "\n", "\t", "\xa0", "1", "²", ".", "🦣", "日", "　"]
    for _ in range(300):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(r.randrange(1, 8))]
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        starts, first = bpe.find(data, offsets, {})
        words = [data[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(data)])]
        assert [words[a:b] for a, b in zip(first[:-1], first[1:])] == [pattern.findall(t) for t in texts]


def test_places_and_ids_survive_packing():
    r = np.random.default_rng(2)
    for x in ([], [0], [127, 128, 1 << 14, (1 << 21) - 1, 1 << 21, (1 << 28) - 1], r.integers(0, 1 << 28, 1000)):
        assert bpe._unpacked(bpe._packed(np.array(x, np.int64))).tolist() == list(x)


def test_distinct_words_are_encoded_once(spark):
    encode = bpe.Encoder(bpe.tokenizer_json())
    calls, library = [], encode.tokenizer

    class Counting:
        def encode_batch(self, words, **options):
            calls.extend(words)
            return library.encode_batch(words, **options)

    encode.tokenizer = Counting()
    one, two = encode([b"a", b"bc"]), encode([b"bc", b"d", b"a"])
    assert calls == ["a", "bc", "d"] and two[0] == one[1] and two[2] == one[0]


def test_a_word_of_many_blocks_has_one_bucket(spark):
    docs = spark.createDataFrame([(i, "the same words stand here") for i in range(200)], "doc_id long, text string").repartition(8)
    blocks = docs.mapInArrow(bpe._blocks({}, 5, 100), bpe._BLOCK).where("bucket is not null").collect()
    found = [(w, r["bucket"], r["block"]) for r in blocks for w in bpe._words(bytes(r["words"]))]
    assert len({w for w, _, _ in found}) == len({(w, b) for w, b, _ in found}) == 5
    assert len(found) == len(set(found)) > 50


def test_decoding_of_encoded_rows(spark, edge, edge_rows):
    both = edge.where("doc_id is not null and doc_id <> 44")
    apart = bpe.decode(bpe.encode(both)).select("doc_id", "ids", "decoded").collect()
    assert sorted(map(tuple, apart)) == sorted(map(tuple, bpe.encode_and_decode(both).select("doc_id", "ids", "decoded").collect()))


def test_broken_ids_decode_with_replacement(spark):
    raw = spark.createDataFrame([(1, 1, bytearray(np.array([160], "<u4").tobytes()))], "doc_id long, n_tokens long, ids binary")
    assert "�" in bpe.decode(raw).first()["decoded"]


def test_bpe_of_nothing(spark, empty):
    assert bpe.encode(empty).count() == 0
    d = bpe.digest(bpe.encode_and_decode(spark.createDataFrame([(1, None)], "doc_id long, text string"))).first()
    assert d["n_tokens"] == 0 and d["ids_sha256"] == d["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_workers_take_little_memory(monkeypatch):
    """4 MB of text, and a run of 1 MB of ids that stand for 4 MB."""
    from pyspark import TaskContext

    class Context:
        def partitionId(self):
            return 0

    monkeypatch.setattr(TaskContext, "get", staticmethod(Context))
    bpe.kinds()
    texts = pa.array([" ".join(words(i, 500)) for i in range(2000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["doc_id", "text"])
    assert peak(lambda: [r.num_rows for r in bpe._blocks({}, 7, 4 << 20)(iter([batch]))]) < 45e6
    rows = [np.arange(1 << 12, dtype="<u4").tobytes()] * 64
    kinds = [("ids", pa.binary()), ("_id", pa.int32()), ("_rest", pa.int32()), ("piece", pa.binary())]
    asked = [(r, None, 1 << 12, None) for r in rows] + [(None, i, (1 << 12) - 1 - i, b"%16d" % i) for i in range(1 << 12)]
    met = pa.RecordBatch.from_arrays([pa.array([a[k] for a in asked], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])
    read = []
    assert peak(lambda: read.extend(r.num_rows for r in bpe._decode(["ids"])(iter([met])))) < 40e6
    assert sum(read) == 64


def test_numbers_of_a_block_are_read_a_part_at_a_time(monkeypatch):
    x = np.array([0, 127, 128, 1 << 14, (1 << 21) - 1, 1 << 21, (1 << 28) - 1, 5] * 3)
    for part in (1, 2, 3, 7, 1 << 17):
        monkeypatch.setattr(bpe, "PART", part)
        assert bpe._unpacked(bpe._packed(x)).tolist() == x.tolist()
        assert len(bpe._unpacked(bpe._packed(x[:0]))) == 0
    raw = bpe._packed(np.arange(1 << 21))
    assert peak(lambda: bpe._unpacked(raw)) < 30e6


def test_bpe_gives_back_unused_heap_before_it_splits_and_before_it_encodes(spark):
    beans = list(spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    collected = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    before = collected()
    bpe.op5_bpe(spark, "/root/testdata/sf0.001")
    assert collected() >= before + 2


def test_a_worker_holds_no_tables_of_tasks_before():
    bpe.tokenizer(bpe.tokenizer_json())
    kernels.powers(3, 1 << 20)
    assert list(bpe._decode(["ids"])(iter([]))) == []
    assert not bpe._tokenizers and not kernels._powers
