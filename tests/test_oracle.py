"""Every query at the smallest size: equal to its SQL, or at least a result."""

import pytest

from flowquarry.plans.catalog import ORACLE, QUERIES
from tests.oracle import DATA, compare, connect

SMALL = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert sum(r["windows"] for r in rows) > 0
    assert set(e.oracle_sql()) <= set(e.queries())
