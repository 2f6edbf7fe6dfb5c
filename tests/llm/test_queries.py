import pytest

from tests.conftest import SMALL
from tests.oracle import differences
from tilewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, name):
    assert differences(queries.QUERIES[name](spark, SMALL), con, queries.SQL[name]) == ""
