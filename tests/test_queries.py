"""Every registered query against its SQL twin at the smallest scale."""

import pytest

from __spark_entry__ import entry
from commercelake.plans.catalog import ORACLES, QUERIES
from tests.oracle import TESTDATA, compare, connect

FOLDER = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    assert compare(QUERIES[key](spark, FOLDER), con, ORACLES[key]) is None
