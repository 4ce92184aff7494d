import pytest

from tidegrid.llm.queries import QUERIES
from tidegrid.llm.sql import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
