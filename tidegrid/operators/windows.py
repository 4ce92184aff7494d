"""Ordered features of weekly series, each leak-free at its row unless said otherwise."""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NO_SPIKE_WEEKS = 999.0


def _ordered(day: str):
    return Window.partitionBy("site").orderBy(day)


def persistence(df: DataFrame, value: str = "da_raw", day: str = "week", spike: float = 20.0) -> DataFrame:
    """Adds last_observed and weeks_since_spike (NO_SPIKE_WEEKS if none), the row itself included.

    A spike is a value above ``spike``. Series have one row per site and day; a NULL value is a gap.
    """
    so_far = _ordered(day).rowsBetween(Window.unboundedPreceding, 0)
    last_spike = F.max(F.when(F.col(value) > spike, F.col(day))).over(so_far)
    return df.withColumns({
        "last_observed": F.last(value, ignorenulls=True).over(so_far),
        "weeks_since_spike": F.coalesce(F.datediff(day, last_spike) / 7.0, F.lit(NO_SPIKE_WEEKS)),
    })


def rolling_past(df: DataFrame, value: str = "last_observed", day: str = "week", mean: Sequence[int] = (4,),
                 spread: Sequence[int] = (4, 8, 12)) -> DataFrame:
    """Adds roll_mean_n, roll_std_n, roll_max_n over the n rows before the row; a std of one value is NULL."""
    new = {}
    for n in mean:
        new[f"roll_mean_{n}"] = F.avg(value).over(_ordered(day).rowsBetween(-n, -1))
    for n in spread:
        past = _ordered(day).rowsBetween(-n, -1)
        new[f"roll_std_{n}"] = F.stddev_samp(value).over(past)
        new[f"roll_max_{n}"] = F.max(value).over(past)
    return df.withColumns(new)


def observation_lags(df: DataFrame, value: str = "da_raw", day: str = "week", lags: Sequence[int] = (1, 2, 3, 4),
                     ages: Sequence[int] = (2, 3)) -> DataFrame:
    """Adds prev_obs_k, the k-th latest observed value strictly before the row, their ages in weeks, and prev_obs_diff."""
    over = f"OVER (PARTITION BY site ORDER BY {day})"
    lag = lambda what, k: F.expr(f"lag({what}, {k}) IGNORE NULLS {over}")
    observed = f"CASE WHEN {value} IS NOT NULL THEN {day} END"
    new = {f"prev_obs_{k}": lag(value, k) for k in lags}
    new |= {f"prev_obs_{k}_weeks": F.datediff(F.col(day), lag(observed, k)) / 7.0 for k in ages}
    out = df.withColumns(new)
    return out.withColumn("prev_obs_diff", F.col("prev_obs_1") - F.col("prev_obs_2")) if {1, 2} <= set(lags) else out


def decay_fill(df: DataFrame, value: str, rate: float, day: str = "week", max_gap: int | None = None, name: str | None = None) -> DataFrame:
    """Adds the value with gaps filled by exponential decay of the last one, and 0 before the first.

    With ``max_gap``, weeks further from the last value are 0; without, decay has no end.
    """
    so_far = _ordered(day).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(value, ignorenulls=True).over(so_far)
    seen = F.max(F.when(F.col(value).isNotNull(), F.col(day))).over(so_far)
    gap = F.datediff(F.col(day), seen) / 7.0
    filled = last * F.exp(-rate * gap)
    if max_gap is not None:
        filled = F.when(gap <= max_gap, filled)
    return df.withColumn(name or f"{value}_filled", F.coalesce(value, filled, F.lit(0.0)))


def calendar_features(df: DataFrame, day: str = "week") -> DataFrame:
    """Adds sin_day_of_year and cos_day_of_year (a year has 365 days) and month."""
    angle = 2 * F.pi() * F.dayofyear(day) / 365
    return df.withColumns({"sin_day_of_year": F.sin(angle), "cos_day_of_year": F.cos(angle), "month": F.month(day)})


def forward_fill(df: DataFrame, value: str, day: str = "week") -> DataFrame:
    """The column with each gap filled by the last value of the site; leading gaps stay NULL."""
    return df.withColumn(value, F.last(value, ignorenulls=True).over(_ordered(day).rowsBetween(Window.unboundedPreceding, 0)))


def hashed_sample(df: DataFrame, *, group: str, key: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """ceil(fraction x rows) rows of each group without replacement, in an order hashed from key and seed.

    A group is ranked in 256 parts by the first byte of the hash, whose sizes give each part's
    first rank; parts beyond the share are dropped before any row is ranked. Rows with equal keys
    stand in any order; rows with a NULL group are a group of their own.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    hashed = df.withColumns({"_digest": digest, "_part": F.substring(digest, 1, 2)})
    sizes = hashed.groupBy(F.col(group).alias("_group"), "_part").agg(F.count("*").alias("_n"))
    parts = Window.partitionBy("_group")
    ranked = sizes.select(
        "_group", F.col("_part").alias("_p"), (F.sum("_n").over(parts.orderBy("_part")) - F.col("_n")).alias("_before"),
        F.ceil(F.sum("_n").over(parts) * F.lit(fraction)).alias("_take"),
    ).where("_before < _take")
    kept = hashed.join(ranked, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy(group, "_part").orderBy("_digest", *key))
    return kept.withColumn("_nth", nth).where("_nth <= _take").select(*df.columns)


def history_counts(df: DataFrame, day: str = "date", lead_days: int = 7) -> DataFrame:
    """Adds n_history: the site's rows at least ``lead_days`` before the row's day.

    Rows are first counted per site and day, so the window runs over days and not over rows.
    """
    days = df.groupBy("site", F.col(day).alias("_day")).agg(F.count("*").alias("_n")).withColumn("_d", F.unix_date("_day"))
    before = Window.partitionBy("site").orderBy("_d").rangeBetween(Window.unboundedPreceding, -lead_days)
    counted = days.select("site", F.col("_day").alias(day), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("n_history"))
    return df.join(counted, ["site", day])


def with_known_weeks(rows: DataFrame, weekly: DataFrame, day: str = "date", lead_days: int = 7) -> DataFrame:
    """Adds n_weeks: the site's observed weeks that begin at least ``lead_days`` before the row's day.

    Days and weeks of a site are merged once, and a running count over them answers every day.
    """
    days = rows.select("site", F.date_sub(day, lead_days).alias("_at")).distinct().withColumn("_n", F.lit(0))
    known = weekly.select("site", F.col("week").alias("_at"), F.lit(1).alias("_n"))
    so_far = Window.partitionBy("site").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    counted = days.unionByName(known).groupBy("site", "_at").agg(F.sum("_n").alias("_n"), F.min("_n").alias("_asked")).select(
        "site", F.date_add("_at", lead_days).alias(day), F.sum("_n").over(so_far).alias("n_weeks"), "_asked"
    )
    return rows.join(counted.where("_asked = 0").drop("_asked"), ["site", day])


_HISTORY = "site string, test_date date, n long, mean double, q99 double, med double, lo double, hi double, last_observed double, weeks_since_spike double"


def _quantile(ordered: list[float], q: float) -> float:
    place = q * (len(ordered) - 1)
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    return (1 - (place - low)) * ordered[low] + (place - low) * ordered[high]


def expanding_history(weekly: DataFrame, min_rows: int = 10, lead_days: int = 7, spike: float = 20.0) -> DataFrame:
    """Each (site, week, da_raw) row as a test date, with statistics of the site's rows at least ``lead_days`` before it.

    The same as an aggregate over ``training_windows`` with every row as an anchor, without its
    anchors x history rows: one pass over a site's weeks, whose number the lattice bounds, keeps
    the values so far in order. ``weeks_since_spike`` counts to the test date. Test dates with
    fewer than ``min_rows`` rows before them don't appear.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        site, weeks, values = pdf["site"].iloc[0], pdf["week"].tolist(), pdf["da_raw"].tolist()
        rows, ordered, total, last_spike, known = [], [], 0.0, None, 0
        for week in weeks:
            while known < len(weeks) and (week - weeks[known]).days >= lead_days:
                insort(ordered, values[known])
                total += values[known]
                last_spike = weeks[known] if values[known] > spike else last_spike
                known += 1
            if known >= min_rows:
                since = (week - last_spike).days / 7.0 if last_spike is not None else NO_SPIKE_WEEKS
                rows.append((site, week, known, total / known, _quantile(ordered, 0.99), _quantile(ordered, 0.5), ordered[0], ordered[-1], values[known - 1], since))
        return pd.DataFrame(rows, columns=[part.split(" ")[0] for part in _HISTORY.split(", ")])

    return weekly.select("site", "week", "da_raw").where("da_raw IS NOT NULL").groupBy("site").applyInPandas(one, _HISTORY)
