import sqlite3
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from cairnstone.functions import text as X
from cairnstone.operators.store import Conflict, NotFound, Store, fold_commits, heads

BASE = {"title": "Pagination decision", "kind": "decision", "tags": ["api"], "source": "src/api.rs"}


def put(store, project, key, content, expected=None):
    return store.remember(project, key, content=content, expected_revision=expected, **BASE)


def test_isolation_revisions_and_recreation(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert put(s, "one", "cursor", "use cursor pagination")["revision"] == 1
    put(s, "two", "cursor", "private words")
    assert s.recall("one", "private")["memories"] == []
    assert len(s.recall("one", "cursor pagination")["memories"]) == 1
    with pytest.raises(Conflict):
        put(s, "one", "cursor", "again")
    assert put(s, "one", "cursor", "offsets now", 1)["revision"] == 2
    assert s.recall("one", "cursor")["memories"] == []
    assert [r["revision"] for r in s.history("one", "cursor")] == [2, 1]
    with pytest.raises(Conflict):
        s.forget("one", "cursor", 1)
    s.forget("one", "cursor", 2)
    assert s.history("one", "cursor") == []
    with pytest.raises(NotFound):
        s.get("one", "cursor")
    assert put(s, "one", "cursor", "back")["revision"] == 3
    with pytest.raises(Conflict):
        put(s, "one", "cursor", "stale", 1)
    assert {(r["project"], r["revision"]) for r in heads(s.log()).collect()} == {("one", 3), ("two", 1)}


def test_an_update_replaces_every_field(spark, tmp_path):
    s = Store(spark, str(tmp_path), clock=iter(range(10)).__next__)
    put(s, "p", "k", "a")
    s.remember("p", "k", "t", "b", expected_revision=1)
    got = s.get("p", "k")
    assert got["tags"] == [] and got["source"] is None and got["kind"] == "note" and (got["created_at"], got["updated_at"]) == (0, 1)


def test_one_of_two_writers_wins(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    put(s, "p", "k", "a")

    def write(text):
        try:
            return put(Store(spark, str(tmp_path)), "p", "k", text, 1)["revision"]
        except Conflict:
            return "conflict"

    with ThreadPoolExecutor(2) as pool:
        assert sorted(map(str, pool.map(write, "xy"))) == ["2", "conflict"]


@pytest.mark.parametrize("budget", [512, 1024, 16000])
def test_byte_budget(budget):
    content = '🦣\n"\\' * 4000
    rows = [{"key": "a", "content": content, "n": None}, {"key": "b", "content": "Second entry", "n": None}]
    out = X.within_budget(rows, 10, budget)
    assert out["truncated"] and out["used_bytes"] <= budget
    assert out["used_bytes"] == len(("[" + ",".join(map(X.encoded, out["memories"])) + "]").encode())
    assert out["memories"][0]["content"].endswith(X.MARK)


def test_more_than_the_limit_is_truncated():
    assert X.within_budget([{"content": "a"}, {"content": "b"}], 1, 512)["truncated"]


def test_refused_inputs(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for bad in ({"limit": 0}, {"max_bytes": 1}, {"query": '"***'}, {"project": " "}, {"query": "x" * 1001}):
        with pytest.raises(X.Invalid):
            s.recall(**{"project": "p"} | bad)
    with pytest.raises(X.Invalid):
        put(s, "p", "k", "x" * 65537)
    assert s.recall("p", '" OR project:other')["memories"] == []
    with pytest.raises(X.Invalid):
        put(Store(spark, str(tmp_path), read_only=True), "p", "k", "x")


def test_a_later_version_is_refused(spark, tmp_path):
    (tmp_path / "version").write_text("99")
    with pytest.raises(X.Invalid):
        Store(spark, str(tmp_path))


def test_commits_fold_in_order(spark):
    rows = [("p", "k", 1, "put", None), ("p", "k", 2, "put", None), ("p", "k", 3, "put", 1), ("p", "k", 4, "delete", 1), ("p", "k", 5, "delete", 2), ("p", "k", 6, "put", 0)]
    out = fold_commits(spark.createDataFrame(rows, "project string, key string, seq long, op string, expected long")).orderBy("seq").collect()
    assert [(r["ok"], r["revision"]) for r in out] == [(True, 1), (False, 1), (True, 2), (False, 2), (True, 0), (True, 3)]


ROWS = [(1, "API pagination", "Use cursor pagination for the event log", '["api"]'), (2, "Tests", "Run cargo test before pagination", '["ci","tests"]'), (3, "Naming", "snake_case foo_bar names, café Straße", "[]"), (4, "Other", "nothing here at all except api", '["misc"]'), (5, "More", "one two three four five", "[]"), (6, "Z", "zeta eta theta", "[]")]


@pytest.mark.parametrize("q", ["pagination", "PAGINATION api", "foo_bar", "cafe", "strasse", "api", "case foo"])
def test_relevance_is_that_of_a_full_text_index(spark, q):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE s USING fts5(title, content, tags)")
    db.executemany("INSERT INTO s(rowid, title, content, tags) VALUES (?, ?, ?, ?)", ROWS)
    match = " AND ".join(f'"{t}"' for t in X.query_terms(q))
    want = db.execute("SELECT rowid, bm25(s, 4.0, 1.0, 2.0) FROM s WHERE s MATCH ?", (match,)).fetchall()
    df = X.folded_tokens(spark.createDataFrame(ROWS, "id long, title string, content string, tags string"), ["title", "content", "tags"])
    got = X.ranked(df, [X.index_tokens(t) for t in X.query_terms(q)]).select("id", "score").collect()
    assert sorted((i, round(s, 8)) for i, s in want) == sorted((r["id"], round(r["score"], 8)) for r in got)


def test_unwritten_store_is_empty(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.recall("p")["memories"] == [] and s.log().where(F.lit(True)).count() == 0


def test_an_index_follows_later_revisions_and_deletions(spark, tmp_path):
    from pyspark.sql import functions as F

    from cairnstone.functions import text as X

    schema = "project string, key string, revision long, updated_at long, id long, deleted boolean, title string, content string, tags array<string>"
    first = [("p", "a", 1, 10, 1, False, "Über uns", "naïve words here", ["x"]), ("p", "b", 1, 11, 2, False, "uber", "other words", []), ("q", "c", 1, 12, 3, False, "plain", "words words", ["uber"])]
    later = [("p", "a", 2, 20, 1, False, "renamed", "new words", []), ("q", "c", 2, 21, 3, True, None, None, None)]
    path = str(tmp_path / "index")

    def found(*terms):
        rows = X.from_index(spark.read.parquet(f"{path}/heads"), spark.read.parquet(f"{path}/postings"), list(terms))
        return {(r["project"], r["key"], r["revision"]) for r in rows.collect()}

    X.append_index(spark.createDataFrame(first, schema), path)
    assert found("uber") == {("p", "a", 1), ("p", "b", 1), ("q", "c", 1)} and found("naive", "uber") == {("p", "a", 1)}
    X.append_index(spark.createDataFrame(later, schema), path)
    assert found("uber") == {("p", "b", 1)} and found("words") == {("p", "a", 2), ("p", "b", 1)} and found("new", "renamed") == {("p", "a", 2)}
    plan = X.from_index(spark.read.parquet(f"{path}/heads"), spark.read.parquet(f"{path}/postings"), ["uber"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and spark.read.parquet(f"{path}/postings").where(F.col("term") == "uber").select("part").distinct().count() == 1
