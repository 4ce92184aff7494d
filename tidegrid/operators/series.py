"""Measurement series: typed raw rows, weekly buckets and the site-by-week lattice."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalars import is_below_limit, monday, reading_value, site_key

FIRST_WEEK, LAST_WEEK = date(2003, 1, 6), date(2023, 12, 25)


def raw_series(samples: DataFrame, *, site: str = "site", moment: str = "collect_date", result: str = "domoic_result",
               keep: tuple[str, ...] = ("sample_id",), censored: str = "drop") -> DataFrame:
    """(site, t, date, da_raw, *keep): the measurements that are plain non-negative numbers.

    Results below the reporting limit (``<x``) are dropped, or count as x/2 with ``censored`` =
    ``half``. Rows with a NULL site, time or measurement are left out; repeats are kept.
    """
    value = reading_value(F.col(result))
    if censored == "drop":
        value = F.when(~is_below_limit(F.col(result)), value)
    elif censored != "half":
        raise ValueError(f"censored must be drop or half, not {censored}")
    return samples.select(
        site_key(F.col(site)).alias("site"), F.col(moment).alias("t"), F.to_date(moment).alias("date"), value.alias("da_raw"), *keep
    ).where("site IS NOT NULL AND t IS NOT NULL AND da_raw IS NOT NULL")


def weekly_max(raw: DataFrame, value: str = "da_raw", day: str = "date") -> DataFrame:
    """(site, week, value): the largest value of each site and week; weeks start on Monday."""
    return raw.groupBy("site", monday(F.col(day)).alias("week")).agg(F.max(value).alias(value))


def lattice(sites: DataFrame, first: date = FIRST_WEEK, last: date = LAST_WEEK) -> DataFrame:
    """(site, week): every distinct site of ``sites`` with every Monday between two dates."""
    weeks = F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 7 days")))
    return sites.select("site").where("site IS NOT NULL").distinct().select("site", weeks.alias("week"))


def on_lattice(weekly: DataFrame, first: date = FIRST_WEEK, last: date = LAST_WEEK) -> DataFrame:
    """The weekly series on its lattice; unobserved weeks have NULL values, weeks outside are cut.

    The sides are merged: sizes are estimated from the sites before they are exploded, so that a lattice of any size
    could be broadcast where a filter on the value makes the join an inner one.
    """
    return lattice(weekly, first, last).hint("merge").join(weekly, ["site", "week"], "left")


def month_shift(day: Column, months: int) -> Column:
    return F.add_months(F.trunc(day, "month"), months)
