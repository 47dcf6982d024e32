"""Every query that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    """Column names and rows as text, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {n for n in QUERIES if n.startswith("op") or n == "pipeline"}))
def test_others_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["path", "name", "n"] and got.count() > 0
