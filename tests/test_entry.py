"""Every query of the engine against its SQL on the smallest tables."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def _names():
    from seekframe.plans import catalogue

    return sorted(catalogue.ORACLE_SQL)


def _same(a, b):
    key = lambda r: tuple((x is None, round(x, 6) if isinstance(x, float) else str(x)) for x in r)
    return sorted(map(key, a)) == sorted(map(key, b))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", _names())
def test_query(spark, con, name):
    from seekframe.plans import catalogue

    df = catalogue.QUERIES[name](spark, SF)
    found = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    assert _same([tuple(r[c] for c in columns) for r in df.collect()], [tuple(r[i] for i in at) for r in found.fetchall()])


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0
