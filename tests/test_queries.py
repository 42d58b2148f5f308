import __spark_entry__ as contract
import pytest
from oracle import check

from arcflow import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_against_sql(spark, small, name):
    check(spark, small, QUERIES[name], SQL[name])


def test_entry(spark):
    assert contract.entry(spark).count() == 200
