"""Decontamination and top-k products against brute force."""

import random

import numpy as np
import pytest
from conftest import documents, words

from cairnstone.llm import decontaminate, products


def edits(w, n, r):
    w = list(w)
    for _ in range(n):
        i, kind = r.randrange(len(w)), r.randrange(3)
        w[i : i + (kind != 2)] = [] if kind == 1 else [f"q{r.randrange(10**6)}"]
    return w


def fits(item, doc, most):
    """Word edit distance of item to the nearest stretch of doc, by the plain recurrence."""
    row = [0] * (len(doc) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row) if min(row) <= most else None


def test_recall_of_edited_items(spark):
    r = random.Random(11)
    items = [(i, words(1000 + i, r.randrange(8, 60), 3000)) for i in range(40)]
    rows = []
    for i in range(120):
        host = words(i, 150, 3000)
        if i < 100:
            w = items[i % 40][1]
            at = r.randrange(len(host))
            host[at:at] = edits(w, int(len(w) * (i % 5) * 0.05), r)
        rows.append((i, " ".join(host)))
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in decontaminate.leaks(documents(spark, rows), bench).collect()}
    want = {}
    for d, t in rows:
        for i, w in items:
            near = fits(w, t.split(), int(0.2 * len(w)))
            if near is not None:
                want[d, i] = near
    assert set(got) <= set(want) and len(want) >= 95
    assert len(set(got) & set(want)) >= 0.95 * len(want)
    assert all(got[k] == want[k] for k in got)
    exact = [k for k, v in want.items() if v == 0]
    assert set(exact) <= set(got)


def test_every_length_and_number_of_edits(spark):
    """Complete recall, by length of item and edits: each cell's leaks are all found, at their distance."""
    r, items, rows, want = random.Random(5), [], [], {}
    for n in [*range(8, 26), 33, 60]:
        for most in range(n // 5 + 1):
            for _ in range(6):
                i = len(items)
                items.append((i, words(5000 + i, n, 10**6)))
                text = words(i, 20, 10**6) + edits(items[-1][1], most, r) + words(90_000 + i, 20, 10**6)
                rows.append((i, " ".join(text)))
                want[i, i] = fits(items[-1][1], text, n // 5)
    assert None not in want.values()
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]): x["distance"] for x in decontaminate.leaks(documents(spark, rows), bench).collect()} == want


def test_an_item_cut_at_the_beginning_of_a_slice(spark):
    item = words(3, 40, 3000)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for cut in range(9):
        rows = [(cut, " ".join(item[cut:] + words(70 + cut, 40, 3000)))]
        got = [tuple(r) for r in decontaminate.leaks(documents(spark, rows).coalesce(1), bench).collect()]
        assert got == [(cut, 1, 0, 40 - cut, cut, 40)]


def test_blocks_of_items_and_edge_cases(spark, edge, empty):
    text = edge.where("doc_id = 5").first()["text"]
    rows = [(1, " ".join(text.split()[10:40])), (2, None), (3, ""), (4, "one two"), (1, " ".join(text.split()[10:40]))]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    one = sorted(map(tuple, decontaminate.leaks(edge, bench).collect()))
    assert one == sorted(map(tuple, decontaminate.leaks(edge, bench, block_bytes=100).collect()))
    assert {r[:2] for r in one} >= {(5, 1)} and {r[1] for r in one} == {1}
    assert all(r[2:] == (10, 40, 0, 30) for r in one if r[0] == 5)
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(edge, bench.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, text), (None, "other words"), (9, text), (9, "more words"), (9, text)], "doc_id long, text string")
    left = decontaminate.clean(odd, bench, block_bytes=100)
    assert sorted(repr(tuple(r)) for r in left.collect()) == sorted(map(repr, [(None, "other words"), (9, "more words")]))
    kept = decontaminate.clean(edge, bench)
    assert kept.columns == edge.columns and kept.count() == edge.count() - sum(edge.where(f"doc_id = {d}").count() for d in {r[0] for r in one})


def brute(x, ids, k=10, every=100):
    """Rankings of every query row against all other rows, sorted."""
    v, out = np.floor(np.asarray(x) * 1024).astype(np.int64), []
    for row, (i, q) in enumerate(zip(ids, v)):
        if i % every == 0:
            s = v @ q
            best = [j for j in np.lexsort((ids, -s)) if j != row][:k]
            out += [(int(i), n, int(ids[j]), int(s[j])) for n, j in enumerate(best, 1)]
    return sorted(out)


BAD = [(None, [1.0] * 8), (5000, None), (5100, [None] * 8), (5200, [float("nan")] * 8), (5300, [float("inf")] * 8)]


@pytest.mark.parametrize("spread, bucket", [(0.0, 256), (1.5, 256), (1.5, 64)])
def test_products(spark, spread, bucket):
    """Repeated vectors, repeated rows, and rows of one id with different vectors, queries among them."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 8)) * np.exp(rng.normal(size=(1500, 1)) * spread)
    x[::5] = x[0]
    ids = np.concatenate((np.arange(1500), [100, 200, 200, 7]))
    x = np.concatenate((x, x[[100, 3, 4, 9]]))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + BAD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in products.top_products(df, bucket_rows=bucket).collect()]
    assert len(got) == 180 and sorted(got) == brute(x, ids)


def test_products_sql_on_repeated_rows(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[50:90] = x[:40]
    rows = [(int(i), v.tolist()) for i, v in zip([*range(280), *range(0, 200, 10)], x)] + BAD
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in products.op9_top_products(spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(c.sql(products.ORACLE).fetchall())


def test_vectors_of_large_components(spark):
    """Doubles beyond 2**52 are integers; what no long holds counts as the nearest one."""
    x = [[2.0**44, 1.0], [2.0**43, 2.0], [-(2.0**45), 3.0], [2.0**50, 0.0], [1e300, 0.0], [0.5, -1e300]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    most, least = 2**63 - 1, -(2**63)
    v = [[max(least, min(most, int(np.floor(c * 1024)))) if abs(c) < 1e299 else (most if c > 0 else least) for c in r] for r in x]
    s = [max(least, min(most, sum(a * b for a, b in zip(v[0], r)))) for r in v]
    want = [(0, n, j, s[j]) for n, j in enumerate(sorted(range(1, 6), key=lambda j: (-s[j], j)), 1)]
    assert sorted(map(tuple, products.top_products(df).collect())) == want


def test_few_candidates_dimensions_and_nothing(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [-1.0, 0.0]), (100, [3.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, products.top_products(df).collect())) == [(0, 1, 1, 512 * 1024), (0, 2, 2, -1024 * 1024)]
    assert products.top_products(df.limit(0)).count() == 0


def test_large_integers_stay_exact():
    q, b = np.array([[2**40, 3]], np.int64), np.array([[2**20, 1], [2**21, 7]], np.int64)
    assert products.products(q, b).tolist() == [[2**60 + 3, 2**61 + 21]]


def test_coordinate_pruning_is_sound():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(2000, 4))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for cosine in (0.3, 0.8, 0.99):
        low, high = products.feasible(u[0, 1], cosine)
        near = u[u @ u[0] >= cosine]
        assert ((near[:, 1] >= low) & (near[:, 1] <= high)).all()


def test_hashing_a_large_slice_takes_little_memory():
    import tracemalloc

    import pyarrow as pa

    column = pa.array([None, "", *[" ".join(words(i, 500, 3000)) for i in range(1700)]])
    whole, first = decontaminate.words(column)
    tracemalloc.start()
    decontaminate.words(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first[-1] == len(whole) == 850_000 and first[:3].tolist() == [0, 0, 0] and np.array_equal(whole[-500:], decontaminate.words(column.slice(1701))[0])
    assert peak < 100 << 20
