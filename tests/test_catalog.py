"""Every registered query beside its SQL, on the smallest tables."""

import pytest

from compare import compare, connect
from themeloom.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, sf, key):
    sql = ORACLES.get(key)
    rows, problem = compare(spark, con, sf, QUERIES[key], sql() if callable(sql) else sql)
    assert problem is None
    assert rows >= 0
