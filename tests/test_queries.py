"""Every registered query against its SQL on the smallest tables."""

import pytest

from homestream.plans.oracles import ORACLES
from homestream.plans.queries import QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal(spark, con, name):
    assert compare(con, QUERIES[name](spark, SF), ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["location", "record_time", "value"] and df.count() > 0
