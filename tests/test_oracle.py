"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from queries import ORACLES, QUERIES
from queries.check import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name], data) is None
    else:
        assert QUERIES[name](spark, data).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
