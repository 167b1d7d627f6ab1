"""Each query that SQL can express equals it, on the smallest tables."""

import pytest

from gridloom.catalog.queries import ORACLES, QUERIES
from tests.oracle import run_sql, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert same(QUERIES[name](spark, SF).toPandas(), run_sql(ORACLES[name], SF))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
