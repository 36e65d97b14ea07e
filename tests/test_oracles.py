"""Every core query with SQL gives the same rows as the SQL; the others run and give rows of a stable shape."""

import importlib

import pytest

from tests.oracle import compare, views

MODULES = ["general", "kg", "programs", "analytics", "more"]
QUERIES, SQL = {}, {}
for m in MODULES:
    mod = importlib.import_module(f"cairn.queries.{m}")
    QUERIES |= mod.QUERIES
    SQL |= mod.SQL


EMPTY_AT_THIS_SCALE: set[str] = set()


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    compare(QUERIES[name](spark, data), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and (df.count() > 0 or name in EMPTY_AT_THIS_SCALE)


def test_entry_registers_everything():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q)
    assert set(QUERIES) <= set(q)
