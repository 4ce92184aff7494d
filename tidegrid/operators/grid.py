"""Irregular readings onto a regular grid of weeks.

Readings of a cumulative counter are differenced between consecutive readings, a fall of the
counter being a reset; each increment is spread over the grid cells that its interval overlaps,
in proportion to the overlap. Levels are brought into the same form as the counter of level x
time that they accumulate. Cells without reading, and the parts of cells that no admissible
interval covers, are marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalars import wall_micros

_DAY_US = 86_400_000_000


def _week_start(micros: Column) -> Column:
    """Monday 00:00 in microseconds; the epoch is a Thursday."""
    shifted = micros + F.lit(3 * _DAY_US)
    return shifted - F.pmod(shifted, F.lit(7 * _DAY_US)) - F.lit(3 * _DAY_US)


def _step(kind: str, last_value: Column, value: Column, micros: Column) -> Column:
    """The difference of the counter between two readings, below zero if it fell."""
    return value - last_value if kind == "counter" else last_value * (micros / _DAY_US)


def _increment(kind: str, step: Column, value: Column) -> Column:
    """What the counter counted in a step: from zero again after a reset."""
    return F.when(step < 0, value).otherwise(step) if kind == "counter" else step


def weekly_grid(
    df: DataFrame, entity: str, moment: str, value: str, *, kind: str = "level", max_gap_days: float | None = None, label: str | None = None
) -> DataFrame:
    """(entity, week_start, readings, increment, resets, covered_share, rate, status), and ``label`` if one is named.

    One row per entity and week, without holes, from the week of its first usable reading to
    that of its last; weeks run from Monday 00:00. ``kind`` is ``counter`` for readings of a
    cumulative counter, which restarts from zero if it falls, or ``level``: a level holds until
    the next reading, and its increments are level x days. ``resets`` are the steps in which the
    counter fell: a counter begins again, a level was negative. ``increment`` is the week's share of
    all increments, ``covered_share`` the part of the week that lies within intervals between
    consecutive readings of at most ``max_gap_days`` (NULL: any), ``rate`` is increment by
    covered day. ``status`` is ``observed`` for a week with a reading, else ``filled`` if an
    admissible interval covers it wholly, else ``missing``; ``readings`` = 0 marks every week
    without one. Longer intervals contribute no increment. ``label`` is a string column that comes
    out with the least of the entity's values in it.

    Rows with a NULL in one of the three columns are no readings; repeated readings, and others
    at the same time, count as one with their largest value. Empty tables give empty results.

    Consecutive readings are paired within (entity, week) first and across weeks after, on one
    summary row per entity and week, so an entity of any size is split by time.
    """
    if kind not in ("counter", "level"):
        raise ValueError(f"kind must be counter or level, not {kind}")
    week_us = 7 * _DAY_US
    limit = F.lit(None).cast("long") if max_gap_days is None else F.lit(int(max_gap_days * _DAY_US))

    named = F.lit(None).cast("string") if label is None else F.col(label)
    readings = (
        df.select(F.col(entity).alias("entity"), wall_micros(F.col(moment)).alias("t"), F.col(value).alias("x"), named.alias("label"))
        .dropna(subset=["entity", "t", "x"])
        .withColumn("week", _week_start(F.col("t")))
        .repartition("entity", "week")
        .groupBy("entity", "week", "t").agg(F.max("x").alias("x"), F.min("label").alias("label"))
    )
    in_week = Window.partitionBy("entity", "week").orderBy("t")
    steps = readings.select(
        "entity", "week", "t", "x", "label", F.lag("t").over(in_week).alias("t0"), F.lag("x").over(in_week).alias("x0")
    )
    gap = F.col("t") - F.col("t0")
    admissible = F.col("t0").isNotNull() & (limit.isNull() | (gap <= limit))
    step = _step(kind, F.col("x0"), F.col("x"), gap)
    inner = F.when(admissible, _increment(kind, step, F.col("x"))).otherwise(0.0)
    weeks = steps.groupBy("entity", "week").agg(
        F.count("*").alias("readings"), F.sum(inner).alias("inside"), F.min("label").alias("label"),
        F.sum(F.when(admissible, gap).otherwise(0)).alias("covered"), F.count_if(admissible & (step < 0)).alias("resets"),
        F.min("t").alias("first_t"), F.min_by("x", "t").alias("first_x"),
        F.max("t").alias("last_t"), F.max_by("x", "t").alias("last_x"),
    )
    # one row per entity and observed week from here on
    across = Window.partitionBy("entity").orderBy("week")
    linked = weeks.select(
        "entity", "week", "readings", "inside", "covered", "resets", "last_t", "last_x",
        F.min("label").over(Window.partitionBy("entity")).alias("label"), F.lead("week").over(across).alias("next_week"),
        F.lead("first_t").over(across).alias("t1"), F.lead("first_x").over(across).alias("x1"),
    )
    span = F.col("t1") - F.col("last_t")
    bridge = _step(kind, F.col("last_x"), F.col("x1"), span)
    carried = F.when(F.col("t1").isNotNull() & (limit.isNull() | (span <= limit)), _increment(kind, bridge, F.col("x1")))
    bridged = linked.select(
        "entity", "week", "readings", "inside", "covered", "resets", "last_t", "t1", "next_week", "label",
        carried.alias("carried"), span.alias("span"), F.when(carried.isNotNull() & (bridge < 0), 1).otherwise(0).alias("reset"),
    )
    # an interval between weeks touches its own week, the empty weeks, and the week it ends in
    cells = bridged.select(
        "*", F.explode(F.sequence("week", F.coalesce("next_week", "week"), F.lit(week_us))).alias("cell")
    )
    overlap = F.greatest(F.lit(0), F.least("t1", F.col("cell") + week_us) - F.greatest("last_t", "cell"))
    own = F.col("cell") == F.col("week")
    ends = F.col("cell") == F.col("next_week")
    part = F.when(F.col("carried").isNotNull() & (F.col("span") > 0), overlap)
    pieces = cells.select(
        "entity", "cell", "label",
        F.when(own, F.col("readings")).otherwise(0).alias("readings"),
        (F.when(own, F.col("inside")).otherwise(0.0) + F.coalesce(F.col("carried") * part / F.col("span"), F.lit(0.0))).alias("increment"),
        F.when(own, F.col("resets")).when(ends, F.col("reset")).otherwise(0).alias("resets"),
        (F.when(own, F.col("covered")).otherwise(0) + F.coalesce(part, F.lit(0))).alias("covered"),
    )
    gridded = pieces.groupBy("entity", "cell").agg(
        F.sum("readings").alias("readings"), F.sum("increment").alias("increment"),
        F.sum("resets").alias("resets"), F.sum("covered").alias("covered"), F.min("label").alias("label"),
    )
    return gridded.select(
        "entity", F.date_from_unix_date((F.col("cell") / _DAY_US).cast("int")).alias("week_start"), "readings", "increment", "resets",
        (F.col("covered") / week_us).alias("covered_share"),
        F.when(F.col("covered") > 0, F.col("increment") / (F.col("covered") / _DAY_US)).alias("rate"),
        F.when(F.col("readings") > 0, "observed").when(F.col("covered") == week_us, "filled").otherwise("missing").alias("status"),
        *([] if label is None else [F.col("label").alias(label)]),
    )
