"""Every registered query against its SQL, over the whole tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from queries import catalogue

SF_DIR = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES = catalogue.QUERIES
SQL = catalogue.SQL


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    wanted = duck.execute(SQL[name])
    columns = [column[0] for column in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert bag(found.columns, found.collect()) == bag(columns, wanted.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["o_orderstatus", "orders", "highest_price"]
    assert found.count() == 3


def test_entry_registers_these_queries():
    assert QUERIES.items() <= __spark_entry__.queries().items()
    assert SQL.items() <= __spark_entry__.oracle_sql().items()
