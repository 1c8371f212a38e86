"""Every query with SQL must give the rows DuckDB gives on the same tables."""

import pytest
from compare import connect, difference

from heatloom.plans.catalogue import ORACLES

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert difference(name, spark, con, ROOT) is None
