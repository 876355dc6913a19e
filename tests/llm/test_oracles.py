"""Queries with a SQL form against DuckDB."""

import pytest

from homestream.llm.oracles import ORACLES
from homestream.llm.queries import QUERIES
from tests.oracle_check import compare, connect


@pytest.mark.parametrize("name", ORACLES)
def test_equals_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert compare(connect(sf_dir), QUERIES[name](spark, sf_dir), ORACLES[name]) is None
