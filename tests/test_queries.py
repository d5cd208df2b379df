"""Every query of the reference's operators against its SQL, on the smallest data."""

import pytest

from framewright.plans import catalog
from tests.compare import connect, differ


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, sf, name):
    assert differ(spark, con, sf, catalog.QUERIES[name], catalog.ORACLES[name]) is None


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
