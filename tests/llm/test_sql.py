"""Training-data queries against their SQL, on the smallest data."""

import pytest

from framewright.llm import queries
from tests.compare import connect, differ


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, name):
    assert differ(spark, connect(sf), sf, queries.queries()[name], queries.oracle_sql()[name]) is None
