"""The queries of the training-data problems that belong to the core, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalars import reading_value, settled, site_key
from tidegrid.operators.dirty_rows import failed_rows, parse_lines, valid_rows
from tidegrid.operators.grid import weekly_grid
from tidegrid.operators.known_attributes import join_known, validity_intervals
from tidegrid.operators.rolling import trailing_totals
from tidegrid.runtime import materialise, table


def usable_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_key, site, collect_date, sample_id, result): the usable samples of da_samples."""
    samples = table(spark, sf_dir, "da_samples")
    return samples.select(
        site_key(F.col("site")).alias("site_key"), "site", "collect_date", "sample_id",
        reading_value(F.col("domoic_result")).alias("result"),
    ).where("site IS NOT NULL AND collect_date IS NOT NULL AND result IS NOT NULL")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_rows(parse_lines(table(spark, sf_dir, "da_file_lines")))


def p1_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = valid_rows(parse_lines(table(spark, sf_dir, "da_file_lines")))
    return parsed.select("line_id", F.col("measured_on").cast("string").alias("measured_on"), "result", "below_limit")


def p2_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = trailing_totals(usable_samples(spark, sf_dir), "site_key", "collect_date", "result", (7, 30))
    rounded = [settled(F.col(c)).alias(c) for c in rolled.columns if c.startswith(("total", "avg", "daily"))]
    return rolled.select(
        F.col("entity").alias("site"), F.col("day").cast("string").alias("day"), "n", "n_7d", "n_30d", *rounded
    )


def _site_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_grid(usable_samples(spark, sf_dir), "site_key", "collect_date", "result", kind="level", max_gap_days=28, label="site")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weeks that the grid marks as without reading.

    The grid is written whole, so that the marks come from its differences, resets and overlaps,
    of which the optimiser would keep none if it saw that only the marks are read.
    """
    silent = materialise(_site_weeks(spark, sf_dir), "site-weeks").where("status <> 'observed'")
    return silent.select("site", F.col("week_start").cast("string").alias("week_start"))


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = _site_weeks(spark, sf_dir)
    return weeks.select(
        F.col("entity").alias("site"), F.col("week_start").cast("string").alias("week_start"), "readings",
        settled(F.col("increment")).alias("increment"), settled(F.col("covered_share")).alias("covered_share"),
        settled(F.col("rate")).alias("rate"), "status",
    )


def p3_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid with the readings taken as a counter that restarts when it falls."""
    weeks = weekly_grid(usable_samples(spark, sf_dir), "site_key", "collect_date", "result", kind="counter")
    return weeks.select(
        F.col("entity").alias("site"), F.col("week_start").cast("string").alias("week_start"), "readings",
        settled(F.col("increment")).alias("increment"), "resets", "status",
    )


def event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(response_id, entity, event_date): only responses without date meet the requests."""
    responses = table(spark, sf_dir, "forecast_responses")
    requests = table(spark, sf_dir, "forecast_requests").select("request_id", "req_date")
    own = responses.where("forecast_date IS NOT NULL").select("response_id", "site", F.col("forecast_date").alias("event_date"))
    borrowed = (
        responses.where("forecast_date IS NULL AND request_id IS NOT NULL").select("response_id", "request_id", "site")
        .join(requests, "request_id").select("response_id", "site", F.col("req_date").alias("event_date"))
    )
    return own.unionByName(borrowed).withColumn("entity", site_key(F.col("site"))).drop("site")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "site_profiles").withColumn("entity", site_key(F.col("site")))
    intervals = validity_intervals(profiles, "entity", "valid_from", "known_at", "version_id")
    met = join_known(event_dates(spark, sf_dir), "entity", "event_date", intervals)
    return met.select("response_id", F.col("known.version").alias("version_id"))


def p4_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each response with the threshold, horizon and plan of its site as known at the event."""
    profiles = table(spark, sf_dir, "site_profiles").withColumn("entity", site_key(F.col("site")))
    kept = ["spike_threshold", "horizon_weeks", "sampling_plan"]
    intervals = validity_intervals(profiles, "entity", "valid_from", "known_at", "version_id", kept)
    met = join_known(event_dates(spark, sf_dir), "entity", "event_date", intervals)
    return met.select("response_id", F.col("event_date").cast("string").alias("event_date"), *[F.col(f"known.{c}").alias(c) for c in kept])


QUERIES = {f.__name__: f for f in (p1_found, p1_measurements, p2_trailing, p3_found, p3_grid, p3_counter, p4_found, p4_attributes)}
