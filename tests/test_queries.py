import pytest

from tests.conftest import SMALL
from tests.oracle import differences
from tilewright.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).collect()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
