"""Every registered query against its SQL oracle (DuckDB) on the small testdata."""

import pytest

import __spark_entry__ as entry
from tillgrid.plans.catalog import ORACLE, QUERIES
from oracle_harness import SF_SMALL, compare, duck

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], ORACLE.get(name), SF_SMALL, con)
    assert r["status"] == "exact", r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert rows[0]["total_sales"] > 0
