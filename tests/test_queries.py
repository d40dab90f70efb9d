"""Every registered query of the conversation engine against its SQL, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def names():
    from talkloom.plans import catalog

    return sorted(catalog.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    told = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(told.columns)
    cols = sorted(df.columns)
    at = [told.columns.index(c) for c in cols]
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in told.fetchall())


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).limit(1).count() == 1
