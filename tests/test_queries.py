"""Every ledger query against its SQL on the smallest tables."""

import pytest
from compare import SMALL, connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from ledgerloom.registry.oracles import oracle_sql as ledger_sql
from ledgerloom.registry.queries import queries as ledger_queries

ORACLES = ledger_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_each_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and set(ORACLES) <= set(ledger_queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, connection, name):
    assert difference(ledger_queries()[name](spark, SMALL), connection, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(ledger_queries()) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert ledger_queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 10
