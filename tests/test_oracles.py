"""Every registered query on the smallest supplied tables, next to its SQL."""

import pytest

import check_oracle
from driftline.catalog import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(small):
    return check_oracle.connect(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    ok, text = check_oracle.compare(spark, con, small, name, ORACLES, QUERIES)
    assert ok, text
