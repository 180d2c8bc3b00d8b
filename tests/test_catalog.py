"""Every registered query of the library against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from quernel import catalog
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, tiny, name):
    df = catalog.queries()[name](spark, tiny)
    names = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert names == sorted(want.columns)
    order = [want.columns.index(c) for c in names]
    assert rows == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert DATA
