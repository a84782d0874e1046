import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n int"


def documents(spark, rows):
    """Documents with two more columns, named like operators' own."""
    full = [(i, t, None if i is None else ("en", "fr")[i % 2], None, None if t is None else len(t), "x", None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty texts, blanks, ties, repeated rows, copies, near copies, shared passages and one very long text."""
    base = [" ".join(words(i, 80)) for i in range(12)]
    passage = " ".join(words(99, 70))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0]), (22, base[1] + " tail"), (23, "lead " + base[2])]
    rows += [(30 + i, base[i] + "\n" + passage + "\n" + base[i + 1]) for i in range(5)]
    rows += [(40, None), (41, ""), (42, " \t\n"), (43, "one"), (44, "one two"), (44, "one two"), (None, base[3]), (None, None), (45, "Ä é ß 日本 🦣 <|endoftext|> it's  ok")]
    rows += [(50, "\n".join(["same line"] * 6)), (51, "a\nb\nc\nd"), (52, "x\na\nb\nc\ny"), (53, "b\nc\nd\ne")]
    rows += [(60, " ".join(words(7, 60_000, 5000)))]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return documents(spark, edge_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, []).limit(0)
