"""Every registered query of the event operators against its SQL, on the smallest tables."""

import pytest

from eventpulse.plans import catalog

from .oracle_compare import connect, rows


@pytest.fixture(scope="module")
def connection(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, small, connection):
    found = catalog.QUERIES[name](spark, small).toPandas()
    if name not in catalog.SQL:
        assert len(found.columns) and len(found)
        return
    expected = connection.sql(catalog.SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
