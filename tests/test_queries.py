"""Every registered query runs; those with SQL must give the rows DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"boolean": "BOOLEAN", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def clean(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(clean(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    result = duck.execute(SQL[name])
    names, types = [c[0] for c in result.description], {c[0]: str(c[1]) for c in result.description}
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert rows_by_name(df.columns, df.collect()) == rows_by_name(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5
