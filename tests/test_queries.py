"""Every query of the core with SQL against DuckDB on the smallest tables; the others must run."""

import pytest

from tidegrid.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
SLOW = {"model12_retrospective", "model14_tuned_sites", "api_forecast_enhanced", "model16_bootstrap"}


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys() - SLOW))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).columns
    QUERIES[name](spark, sf).collect()
