"""Every registered query against its SQL answer on the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import normalised

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ANSWERS = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def test_answers_belong_to_queries():
    assert set(ANSWERS) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name not in ANSWERS:
        assert df.columns
        return
    cursor = duck.execute(ANSWERS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normalised(df.columns, rows) == normalised(columns, cursor.fetchall())
