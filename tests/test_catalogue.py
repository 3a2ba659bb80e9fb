"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from loomdoc.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    r = duck.sql(SQL[name])
    theirs = list(r.columns)
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert ours == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
