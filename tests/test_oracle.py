"""Every registered query with an SQL twin, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

from . import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return oracle.connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = oracle.spark_rows(QUERIES[name](spark, SF))
    assert oracle.compare(got, oracle.duck_rows(duck, SQL[name])) is None
