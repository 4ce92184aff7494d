"""Rolling totals and averages over trailing periods, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def daily_totals(df: DataFrame, entity: str, moment: str, value: str, distinct: bool = True) -> DataFrame:
    """(entity, day, n, total): one row per entity and day with a usable value.

    With ``distinct``, rows of the same entity, time and value count once. Rows with a NULL
    in any of the three are left out. The only shuffle of rows is on entity and day, after
    map-side removal of repeats, so no entity is a hot key.
    """
    rows = df.select(F.col(entity).alias("entity"), F.col(moment).alias("moment"), F.col(value).alias("value")).dropna()
    rows = rows.withColumn("day", F.to_date("moment"))
    if distinct:
        rows = rows.repartition("entity", "day").dropDuplicates(["entity", "day", "moment", "value"])
    return rows.groupBy("entity", "day").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def densify(daily: DataFrame) -> DataFrame:
    """``daily`` joined with the calendar: one row per entity and day of its span, empty days as 0.

    Each active day brings the calendar days up to the next active one, so the join of entity
    and calendar needs neither a second scan for the spans nor a merge of two row sets.
    """
    following = F.lead("day").over(Window.partitionBy("entity").orderBy("day"))
    spanned = daily.withColumn("until", F.coalesce(F.datediff(following, "day"), F.lit(1)) - 1)
    days = spanned.select("entity", "day", "n", "total", F.explode(F.sequence(F.lit(0), F.col("until"))).alias("after"))
    active = F.col("after") == 0
    return days.select(
        "entity", F.date_add("day", F.col("after")).alias("day"),
        F.when(active, F.col("n")).otherwise(0).alias("n"), F.when(active, F.col("total")).otherwise(0.0).alias("total"),
    )


def trailing_totals(
    df: DataFrame, entity: str, moment: str, value: str, days: Sequence[int] = (7, 30), distinct: bool = True
) -> DataFrame:
    """(entity, day, n, total, and for each N of ``days``: n_Nd, total_Nd, avg_Nd, daily_avg_Nd).

    One row per entity and day from its first to its last day with a usable value. ``avg_Nd``
    is the mean of the values in the trailing N days, NULL if there are none; ``daily_avg_Nd``
    is the total over N calendar days, empty ones counting as zero. Entities without usable
    value don't appear; an empty table gives an empty result; further columns are ignored.

    Rows are shuffled on entity and day, daily sums then on entity; densifying and the windows
    stay within that partitioning, which holds one row per entity and day.
    """
    dense = densify(daily_totals(df, entity, moment, value, distinct).repartition("entity"))
    by_day = Window.partitionBy("entity").orderBy("day")
    rolled, shorter = dense, 0
    for length in sorted(days):
        rolled = rolled.withColumns({
            f"{c}_{length}d": _trailing(by_day, c, length, shorter) for c in ("n", "total")
        })
        shorter = length
    columns: list[Column] = []
    for length in days:
        n, total = F.col(f"n_{length}d"), F.col(f"total_{length}d")
        columns += [n, total, F.when(n > 0, total / n).alias(f"avg_{length}d"), (total / length).alias(f"daily_avg_{length}d")]
    return rolled.select("entity", "day", "n", "total", *columns)


def _trailing(by_day: WindowSpec, column: str, length: int, shorter: int) -> Column:
    """The sum over ``length`` rows, put together from sums over ``shorter`` rows where there are some.

    A row is then read a few times and not once for each window it lies in. Nothing is
    subtracted, so that large values leave no traces in later windows.
    """
    if not 1 < shorter < length:
        return F.sum(column).over(by_day.rowsBetween(1 - length, 0))
    whole, rest = divmod(length, shorter)
    earlier = lambda c, k: F.coalesce(F.lag(c, k).over(by_day), F.lit(0))
    parts = [F.col(f"{column}_{shorter}d")] + [earlier(f"{column}_{shorter}d", shorter * i) for i in range(1, whole)]
    parts += [earlier(column, shorter * whole + i) for i in range(rest)]
    return reduce(add, parts)
