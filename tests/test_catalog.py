"""Every query with SQL gives the SQL's rows."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return str(v) if isinstance(v, datetime.date | bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_queries_without_sql_run(spark, sf):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, sf).columns


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
