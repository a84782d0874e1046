"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from cairnstone import plans
from cairnstone.registry import ORACLES, QUERIES
from cairnstone.sources.tables import NAMES

SF = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(r)) for r in df.select(*columns).collect())
    if name not in ORACLES:
        return
    rel = duck.sql(ORACLES[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert [rel.columns[i] for i in order] == columns
    assert got == Counter(repr(tuple(r[i] for i in order)) for r in rel.fetchall())


def test_no_query_keeps_a_view(spark):
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]
