"""Every registered query against its SQL, both run on the same Parquet tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from meterlens.plans.catalogue import queries
from meterlens.plans.oracle import oracle_sql

TABLES = ("events", "orders", "lineitem")
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else (1, repr(value))
    return (0,) if value is None else (2, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_every_sql_has_a_query():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    got = result.collect()
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(names)
    want = cursor.fetchall()
    assert len(want) > 0
    assert rows_of(result.columns, got) == rows_of(names, want)
