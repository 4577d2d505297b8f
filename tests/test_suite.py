"""Every registered query against its SQL on the smallest given tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.suite import load_all
from siltstone.suite.registry import ORACLES, QUERIES

load_all()
ROOT = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return f"decimal {v}" if isinstance(v, Decimal) else str(v)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys() <= entry.queries().keys()
    assert ORACLES.keys() <= entry.oracle_sql().keys()
    assert ORACLES.keys() == QUERIES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, ROOT)
    got = sorted_rows(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == sorted_rows(names, cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["customer", "revenue", "orders"] and df.count() == 10
