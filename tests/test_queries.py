"""Every registered query runs; those with SQL equal it on whole tables."""

import pytest

import __spark_entry__ as entry
from check import compare, duck
from convlens import plans

@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, small_dir, name):
    got = entry.queries()[name](spark, small_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert compare(got, con.execute(sql).df()).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_sql_is_given_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
