"""Every registered query at the smallest scale, against its SQL statement."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns) > 0
    if name in SQL:
        assert compare(got, con.execute(SQL[name]).df()) is None
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
