"""Line dedup, substring dedup and the n-gram join against brute force."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnstone.llm import line_dedup, ngram_join, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def lines_left(rows, run=3):
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, gone = set(), {}
    for r in order:
        a = r[1].split("\n")
        for i in range(len(a) - run + 1):
            key = tuple(a[i : i + run])
            if key in seen:
                gone.setdefault(r, set()).update(range(i, i + run))
            seen.add(key)
    return {r: None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone.get(r, ())) for r in rows}


def test_lines(spark, edge, edge_rows):
    out = line_dedup.dedup_lines(edge)
    assert out.columns == [*edge.columns, "n_lines", "n_removed"]
    got = sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect())))
    want = lines_left(edge_rows)
    assert got == sorted(repr((r[0], want[r])) for r in edge_rows)


def test_no_python_on_the_main_path_of_lines(edge):
    plan = line_dedup.dedup_lines(edge)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = line_dedup.op3_line_dedup(spark, SF).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({line_dedup.ORACLE})").fetchall())


def windows_left(rows, window=50):
    key = lambda i: float("inf") if i is None else i
    first, split = {}, [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - window + 1):
            q = tuple(w[k : k + window])
            first[q] = min(first.get(q, float("inf")), key(i))
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("bits", [26, 2])
def test_substrings(spark, edge, edge_rows, bits):
    got = substring.cut_repeats(edge, filter_bits=bits).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got))) == sorted(map(repr, windows_left(edge_rows)))


def test_repeats_of_periodic_texts(spark):
    """Every length of stretches with one fingerprint, 64 and its multiples among them; copies whole, shifted and within other words."""
    from conftest import documents, words

    rows = []
    for n in (63, 64, 106, 107, 128, 192):
        for period in (1, 7, 43):
            line = words(1000 * n + period, period, 10**6)
            text = (line * 400)[: n + 49]
            i = 10 * len(rows)
            rows += [(i, " ".join(text)), (i + 1, " ".join(text)), (i + 2, " ".join(["lead", *text[3:], "tail"])), (i + 3, "\n".join(text + text))]
    line = " ".join(words(5, 9))
    rows += [(9000 + i, "\n".join([line] * 200)) for i in range(3)]
    got = substring.cut_repeats(documents(spark, rows)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got))) == sorted(map(repr, windows_left(rows)))


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[root(i)] = min(d, smallest.get(root(i), d))
    return [(d, len(s), smallest.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_components(spark, edge, edge_rows, k, percent):
    got = ngram_join.jaccard_components(edge, k, percent).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, components(edge_rows, k, percent)))


def test_a_family_of_near_copies(spark):
    import random

    from conftest import documents, words

    r, base, rows = random.Random(4), words(1, 90, 10_000), []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 6])):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_components(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(components(rows, 3, 90))


def test_long_lists_meet_by_differences(spark, monkeypatch):
    """Families whose copies differ a little or a lot from the pivot, from each other, and in the same words; lists of every length."""
    import random

    from conftest import documents, words

    r, rows = random.Random(6), []
    for family in range(4):
        base = words(family, (60, 60, 200, 25)[family], 10_000)
        tail = words(70 + family, 9, 10_000)
        for i in range(40):
            w = list(base)
            for _ in range(r.choice([1, 2, 3, 4])):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            if i % 3 == 0:
                at = (i % 5) * 4
                w[at : at + 2] = ["same", f"edit{i % 5}"]
            if i % 4 == 0:
                w += tail[: i % 9]
            rows.append((1000 * family + i, " ".join(w)))
    docs = documents(spark, rows)
    for wide, block, levels, p in ((2, 5, 1, 90), (4, 16, 3, 70)):
        monkeypatch.setattr(ngram_join, "WIDE", wide)
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "LEVELS", levels)
        assert sorted(map(tuple, ngram_join.jaccard_components(docs, 3, p).collect())) == sorted(components(rows, 3, p)), (wide, block, levels, p)


def test_sketches_never_exceed_the_difference():
    import numpy as np

    r = np.random.default_rng(5)
    for n, m, both in ((1001, 1001, 900), (1200, 2100, 1100), (5000, 4600, 4500), (3000, 3000, 3000)):
        x = r.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        a, b = ngram_join.long_sketch(x[:n]), ngram_join.long_sketch(x[n - both :])
        assert ngram_join.sketch_distance(a, b) == ngram_join.sketch_distance(b, a) <= n + m - 2 * both


def test_filters_and_joins_find_the_same_sets(spark, edge, edge_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_ROWS", 0)
    got = ngram_join.jaccard_components(edge, 3, 90).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, components(edge_rows, 3, 90)))


def test_a_row_goes_for_its_own_text(spark):
    from conftest import documents, words

    a, b = " ".join(words(1, 60)), " ".join(words(2, 60))
    rows = [(3, a), (7, a + " x"), (7, b), (7, a), (None, a), (None, None), (8, None), (8, ""), (8, None)]
    kept = ngram_join.keep_one(documents(spark, rows)).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in kept) == sorted(map(repr, [(3, a), (7, b), (None, a), (None, None), (8, None), (8, ""), (8, None)]))


def test_one_of_a_group_stays(spark, edge, edge_rows):
    kept = {(r["doc_id"], r["text"]) for r in ngram_join.keep_one(edge).select("doc_id", "text").collect()}
    want = {r for r, (d, _, c) in zip(edge_rows, components(edge_rows, 5, 80)) if d is None or c is None or c >= d}
    assert kept == want


def test_empty_tables(empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    assert substring.cut_repeats(empty).count() == 0
    assert ngram_join.jaccard_components(empty).count() == 0


def test_digest_of_substrings(spark):
    r = substring.op6_substring_dedup(spark, SF).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == r["doc_id"]).first()["text"]
    assert r["n_removed"] or r["kept_sha256"] == hashlib.sha256(" ".join(WORD.findall(text)).encode()).hexdigest()


def test_filters_reach_the_driver_without_python_rows(spark):
    """A filter costs the driver little more than its own bytes."""
    import tracemalloc

    import numpy as np

    from cairnstone.llm import kernels as K
    from cairnstone.llm.shared import bitmap

    keys = spark.range(1 << 18).select(F.xxhash64("id").alias("k"))
    want = keys.toArrow()["k"].to_numpy()
    bitmap(keys.limit(1), "k", 16)
    tracemalloc.start()
    out = bitmap(keys, "k", 22)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    bits = np.frombuffer(out, np.int64)
    assert K.in_bitmap(bits, 22, want).all() and np.bitwise_count(bits.view(np.uint64)).sum() == len(np.unique(want.view(np.uint64) % np.uint64(1 << 22)))
    assert peak < 6 * len(out)
