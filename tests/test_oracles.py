"""Every query that has SQL gives the same rows as DuckDB over the same whole tables."""

import pytest

from hirelake import catalog
from oracle import connect, differences

SF = "/root/testdata/sf0.001"
SLOW = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    mine, theirs, extra, missing = differences(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])
    assert (extra, missing) == ([], []) and mine == theirs


def test_every_query_runs(spark):
    for name, q in catalog.queries().items():
        if name not in catalog.oracle_sql():
            assert q(spark, SF).count() >= 0
