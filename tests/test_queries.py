"""Every registered plan against its SQL, or at least for rows and a stable schema."""

import pytest
from compare import duck, same

from docweave.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Two plans whose brute force is slow even on the smallest tables run in their own tests.
SLOW = {"near_dup_pairs", "dup_components", "coverage"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_matches_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow_matches_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
