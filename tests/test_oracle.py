"""Every catalog query with SQL gives the same rows in Spark and in DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

import tumbler.plans.fits  # noqa: F401
import tumbler.plans.more  # noqa: F401
import tumbler.plans.records  # noqa: F401
from tumbler.plans.catalog import CATALOG

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def norm(x):
        return round(x, 5) + 0.0 if isinstance(x, float) else x

    return Counter(tuple(norm(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", [n for n, (_, text) in CATALOG.items() if text])
def test_matches_duckdb(spark, con, name):
    f, text = CATALOG[name]
    df, want = f(spark, SF), con.sql(text)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, text) in CATALOG.items() if not text])
def test_runs(spark, name):
    assert CATALOG[name][0](spark, SF).count() > 0


def test_comparer_sees_a_difference():
    assert rows(["a", "b"], [(1, 2.0)]) != rows(["a", "b"], [(1, 2.1)])
    assert rows(["b", "a"], [(2.0, 1)]) == rows(["a", "b"], [(1, 2.0)])
