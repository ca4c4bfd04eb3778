"""Every registered query equals its SQL on the smallest tables."""

import os

import pytest

from checks.compare import difference, duck_tables
from checks.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck_tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name in ORACLES:
        assert difference(got, con.sql(ORACLES[name]).df()) is None
    else:
        assert len(got) > 0
