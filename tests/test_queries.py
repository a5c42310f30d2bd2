"""Every core query against its SQL on the smallest tables; those without SQL must run."""

import compare
import pytest

from daram.plans import core, problems

FOLDER = "/root/testdata/sf0.001"
QUERIES = core.queries() | problems.queries()
SQL = core.oracle_sql() | problems.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.tables(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        wanted = con.execute(SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert compare.rows(found) == compare.rows(wanted)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
