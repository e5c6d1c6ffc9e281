"""Every registered listing query against the same question in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from parcelflow.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


def _plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value if isinstance(value, (str, bool)) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, tiny, duck, name):
    got = catalogue.QUERIES[name](spark, tiny)
    want = duck.sql(catalogue.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = sorted((tuple(_plain(r[n]) for n in names) for r in got.collect()), key=str)
    order = [want.columns.index(n) for n in names]
    assert rows == sorted((tuple(_plain(r[i]) for i in order) for r in want.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.isdir("/root/testdata/sf0.001")
