"""Training-data queries against their SQL, on the smallest tables."""

import pytest

from eventpulse.llm.queries import QUERIES, SQL
from tests.oracle_compare import connect, rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, small):
    found, expected = QUERIES[name](spark, small).toPandas(), connect(small).sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
