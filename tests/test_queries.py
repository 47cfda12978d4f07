"""Every registered query against its checking SQL on the smallest tables; rows only where there is no SQL."""

import pytest

import __spark_entry__ as entry
from harness import compare, duck

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = set()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert name in MAY_BE_EMPTY or len(df.take(1)) == 1
        return
    _, faults, _ = compare(df, con, sql)
    assert not faults


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
