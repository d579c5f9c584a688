"""The driver's contract at the smallest tables: stable columns, and equal results where there is SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from folianto import queries


def rows_of(cursor, sql, columns):
    names = ", ".join(f'"{c}"' for c in columns)
    return sorted(cursor.execute(f"select {names} from ({sql})").fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, small, name):
    df = driver.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    sql = driver.oracle_sql().get(name)
    if sql:
        cursor = duckdb.connect()
        for file in os.listdir(small):
            cursor.execute(f"create view {file.split('.')[0]} as select * from '{small}/{file}'")
        assert sorted(x[0] for x in cursor.execute(f"describe {sql}").fetchall()) == columns
        assert got == rows_of(cursor, sql, columns)
    else:
        assert got


def test_entry(spark):
    assert driver.entry(spark).columns == ["doc_id", "score", "title", "author", "genre"]


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
