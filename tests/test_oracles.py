"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from corpusloom.plans import load_all
from oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, SF).collect()
        return
    message = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    if message == "no rows":
        # some reports have nothing to list in the smallest tables, but all have at ten times the size
        message = compare(spark, connect(LARGER), QUERIES[name], ORACLES[name], LARGER)
    assert not message, message
