"""Registered queries against DuckDB, all of them, on driver tables that give every query rows."""

import math
import os

import pytest

import __spark_entry__ as entry
from driver_queries import registry

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("MARKETLOOM_SF", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def clean(v):
        return "NaN" if isinstance(v, float) and math.isnan(v) else repr(v)

    return sorted(tuple(clean(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    want = rows_of(cursor.fetchall(), columns)
    assert want, "nothing to compare"
    assert rows_of(got.collect(), got.columns) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["ticker", "month_end", "price"]


def test_every_query_has_sql():
    assert [n for n, (_, text) in registry.QUERIES.items() if text is None] == []
