"""The registered queries that SQL can express give the same rows in Spark and in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from tests.test_oracle import rows
from tumbler.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())
