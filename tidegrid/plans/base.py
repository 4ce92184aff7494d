"""What the catalogue's queries start from, as frames and as SQL, and how a query is registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalars import count_value, monday, settled, site_key
from tidegrid.operators.series import on_lattice, raw_series, weekly_max
from tidegrid.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by name, each with its SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return keep


def iso(column) -> F.Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def r6(column, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    return settled(c).alias(name or column)


def raw(spark: SparkSession, d: str, censored: str = "drop") -> DataFrame:
    return raw_series(table(spark, d, "da_samples"), censored=censored)


def weekly(spark: SparkSession, d: str) -> DataFrame:
    return weekly_max(raw(spark, d))


def series(spark: SparkSession, d: str) -> DataFrame:
    """(site, week, da_raw) on the full lattice."""
    return on_lattice(weekly(spark, d))


def cell_counts(spark: SparkSession, d: str) -> DataFrame:
    """(site, t, date, pn): cell counts that are numbers, with thousands separators or without."""
    return table(spark, d, "pn_counts").select(
        "pn_id", site_key(F.col("site")).alias("site"), F.col("sampled_at").alias("t"), F.to_date("sampled_at").alias("date"),
        count_value(F.col("pn_count")).alias("pn"),
    ).where("site IS NOT NULL AND date IS NOT NULL AND pn IS NOT NULL")


def results(spark: SparkSession, d: str) -> DataFrame:
    """Successful forecasts with the week's actual measurement: the rows that evaluation runs over."""
    answers = table(spark, d, "forecast_responses").where("success AND forecast_date IS NOT NULL")
    keyed = answers.select(
        "response_id", site_key(F.col("site")).alias("site"), F.col("forecast_date").alias("date"), "task", "model", "prediction",
        "predicted_category", "naive_prediction", "xgb_prediction", "rf_prediction", "spike_probability",
        monday(F.col("forecast_date")).alias("week"),
    )
    return keyed.join(weekly(spark, d).withColumnRenamed("da_raw", "actual"), ["site", "week"])


_BL = "chr(32) || chr(9) || chr(13)"
KEY = f"lower(translate(trim(site, {_BL}), '-_', '  '))"

RAW = f"""raw AS (
  SELECT {KEY} AS site, collect_date AS t, CAST(collect_date AS DATE) AS date, CAST(trim(domoic_result, {_BL}) AS DOUBLE) AS da_raw, sample_id
  FROM da_samples
  WHERE site IS NOT NULL AND collect_date IS NOT NULL AND regexp_full_match(trim(domoic_result, {_BL}), '[0-9]+(\\.[0-9]+)?')
)"""
WEEKLY = RAW + ", weekly AS (SELECT site, CAST(date_trunc('week', date) AS DATE) AS week, max(da_raw) AS da_raw FROM raw GROUP BY 1, 2)"
SERIES = WEEKLY + """, grid AS (
  SELECT site, CAST(unnest(generate_series(DATE '2003-01-06', DATE '2023-12-25', INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT DISTINCT site FROM weekly)
), series AS (SELECT site, week, da_raw FROM grid LEFT JOIN weekly USING (site, week))"""
PN = f"""pn AS (
  SELECT pn_id, {KEY} AS site, sampled_at AS t, CAST(sampled_at AS DATE) AS date, CAST(replace(trim(pn_count, {_BL}), ',', '') AS DOUBLE) AS pn
  FROM pn_counts
  WHERE site IS NOT NULL AND sampled_at IS NOT NULL AND regexp_full_match(trim(pn_count, {_BL}), '([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\\.[0-9]+)?')
)"""
RESULTS = WEEKLY + f""", results AS (
  SELECT a.*, w.da_raw AS actual FROM (
    SELECT response_id, {KEY} AS site, forecast_date AS date, task, model, prediction, predicted_category, naive_prediction, xgb_prediction,
           rf_prediction, spike_probability, CAST(date_trunc('week', forecast_date) AS DATE) AS week
    FROM forecast_responses WHERE success AND forecast_date IS NOT NULL
  ) a JOIN weekly w ON a.site = w.site AND a.week = w.week
)"""


def q6(expression: str) -> str:
    return f"round(({expression}) + 1e-9, 6)"
