"""The queries at the smallest tables: the stated columns and types, distinct rows, and equal results where there is SQL."""

import os

import duckdb
import pytest

from folianto.llm import entry

COLUMNS = {
    "p1_found": [("doc_id", "bigint")],
    "p2_found": [("field", "string"), ("id_a", "bigint"), ("id_b", "bigint")],
    "p3_found": [("field", "string"), ("rec_id", "bigint")],
    "p4_found": [("author_a", "string"), ("author_b", "string")],
    "p5_found": [("book_id", "bigint"), ("genre_id", "int")],
    "p6_found": [("field", "string"), ("rec_id", "bigint")],
    "p7_found": [("doc_id", "bigint"), ("term", "string")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, small, name):
    df = entry.queries()[name](spark, small)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    rows = [repr(tuple(r)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    sql = entry.oracle_sql().get(name)
    if sql:
        cursor = duckdb.connect()
        for file in os.listdir(small):
            cursor.execute(f"create view {file.split('.')[0]} as select * from '{small}/{file}'")
        names = ", ".join(df.columns)
        assert sorted(rows) == sorted(repr(r) for r in cursor.execute(f"select {names} from ({sql})").fetchall())


def test_every_problem_has_queries():
    assert {int(n.split("_")[0][1:]) for n in entry.queries()} == set(range(1, 11))
