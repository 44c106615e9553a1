"""Every text query against its SQL on the smallest tables."""

import pytest
from compare import SMALL, connect, difference

from ledgerloom.llm.queries import oracle_sql, queries

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, connection, name):
    assert difference(queries()[name](spark, SMALL), connection, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert queries()[name](spark, SMALL).count() > 0
