"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.plans import analysis, problems, problems_sql, relational, shaping


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return problems.QUERIES | relational.CATALOGUE.queries | analysis.CATALOGUE.queries | shaping.CATALOGUE.queries


def oracle_sql() -> dict[str, str]:
    return problems_sql.ORACLES | relational.CATALOGUE.sql | analysis.CATALOGUE.sql | shaping.CATALOGUE.sql
