"""Time joins: as-of by key with tolerance, delayed equi-joins, expanding training windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.scalars import wall_micros

_DAY_US = 86_400_000_000


def asof_join(
    left: DataFrame, right: DataFrame, *, by: Sequence[str], left_on: str, right_on: str, payload: Sequence[str],
    tolerance_days: float | None = None, delay_days: float = 0, strict: bool = False, stretch_days: int = 120,
) -> DataFrame:
    """All columns of ``left`` with ``matched_on`` and the payload of the latest earlier right row.

    The right row must not be later than the left time minus ``delay_days`` (with ``strict``:
    must be earlier) and, if ``tolerance_days`` is given, at most that much earlier, the end
    included. The right row counts as a whole: its NULL fields stay NULL. Of right rows at one
    time the largest payload counts. Left rows without partner, or with a NULL key or time,
    keep NULLs; repeated left rows are all kept.

    Rows are partitioned by key and stretch of time, so a large key is spread; what a stretch
    starts with is handed on in one row per key and stretch. Payload names must not be in ``left``.
    """
    us = _DAY_US * stretch_days
    cutoff = wall_micros(F.col(left_on)) - int(delay_days * _DAY_US)
    packed = F.struct(F.col("_t").alias("t"), F.col(right_on).alias("matched_on"), F.struct(*payload).alias("payload"))
    rights = (
        right.withColumn("_t", wall_micros(F.col(right_on))).dropna(subset=[*by, right_on])
        .select(*by, "_t", packed.alias("_right")).groupBy(*by, "_t").agg(F.max("_right").alias("_right"))
        .withColumn("_stretch", F.floor(F.col("_t") / us))
    )
    lefts = left.withColumn("_t", cutoff).withColumn("_stretch", F.floor(F.col("_t") / us))
    side_left, side_right = (0, 1) if strict else (1, 0)
    rows = lefts.withColumn("_row", F.struct(*left.columns)).select(
        *by, "_stretch", "_t", F.lit(side_left).alias("_side"), "_row", F.lit(None).cast(rights.schema["_right"].dataType).alias("_right")
    ).unionByName(
        rights.select(*by, "_stretch", "_t", F.lit(side_right).alias("_side"), "_right"), allowMissingColumns=True
    )
    in_stretch = Window.partitionBy(*by, "_stretch").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_seen", F.last("_right", ignorenulls=True).over(in_stretch)).where(F.col("_side") == side_left)

    closing = rights.groupBy(*by, "_stretch").agg(F.max_by("_right", "_t").alias("_carry"))
    wanted = lefts.select(*by, "_stretch").dropna().distinct().withColumn("_carry", F.lit(None).cast(rights.schema["_right"].dataType))
    so_far = Window.partitionBy(*by).orderBy("_stretch").rangeBetween(Window.unboundedPreceding, -1)
    handed = (
        closing.unionByName(wanted).groupBy(*by, "_stretch").agg(F.max("_carry").alias("_carry"))
        .withColumn("_carry", F.last("_carry", ignorenulls=True).over(so_far))
    )
    met = seen.join(handed, [*by, "_stretch"], "left").withColumn("_best", F.coalesce("_seen", "_carry"))
    ok = F.lit(True) if tolerance_days is None else F.col("_t") - F.col("_best.t") <= int(tolerance_days * _DAY_US)
    keep = F.col("_best").isNotNull() & ok
    for key in by:
        keep = keep & F.col(f"_row.{key}").isNotNull()
    return met.select(
        *[F.col(f"_row.{c}").alias(c) for c in left.columns], F.when(keep, F.col("_best.matched_on")).alias("matched_on"),
        *[F.when(keep, F.col(f"_best.payload.{c}")).alias(c) for c in payload],
    )


def delayed_month_join(left: DataFrame, index: DataFrame, *, day: str, month: str, months_back: int, payload: Sequence[str]) -> DataFrame:
    """``left`` with the payload of the month that lies ``months_back`` before its own.

    Duplicate months of ``index`` count once, with the largest payload; NULL days or months meet
    nothing. The index has a row per month, so the planner may broadcast it by its size.
    """
    once = index.where(F.col(month).isNotNull()).groupBy(F.trunc(month, "month").alias("_month")).agg(F.max(F.struct(*payload)).alias("_p"))
    joined = left.withColumn("_month", F.add_months(F.trunc(day, "month"), -months_back)).join(once, "_month", "left")
    return joined.select(*left.columns, *[F.col(f"_p.{c}").alias(c) for c in payload])


def training_rows(anchors: DataFrame, features: DataFrame, *, site: str = "site", anchor: str = "anchor", day: str = "week") -> DataFrame:
    """Each anchor with all feature rows of its site up to the anchor, however few."""
    return anchors.join(features, site).where(F.col(day) <= F.col(anchor))


def training_windows(anchors: DataFrame, features: DataFrame, *, site: str = "site", anchor: str = "anchor", day: str = "week",
                     min_rows: int = 10) -> DataFrame:
    """Each anchor with all feature rows of its site up to the anchor, the anchor's day included.

    Anchors with fewer than ``min_rows`` such rows don't appear. The result has anchors x history
    rows by nature; both sides are hashed on the site and the anchor's history is bounded by the
    lattice. Anchors' columns must not clash with the features' (site aside).
    """
    met = training_rows(anchors, features, site=site, anchor=anchor, day=day)
    keys = [c for c in anchors.columns]
    sized = met.withColumn("_rows", F.count("*").over(Window.partitionBy(*keys)))
    return sized.where(F.col("_rows") >= min_rows).drop("_rows")


def leakage_report(training: DataFrame, *, keys: Sequence[str], day: str = "week", anchor: str = "anchor", test: str = "test_date",
                   min_rows: int = 1) -> DataFrame:
    """(*keys, last_train, clean): clean if no training row is after the anchor and the test date is.

    Keys with fewer than ``min_rows`` training rows don't appear.
    """
    last = F.max(day)
    checked = training.groupBy(*keys).agg(
        last.alias("last_train"), ((last <= F.max(anchor)) & (F.max(test) > F.max(anchor))).alias("clean"), F.count("*").alias("_rows")
    )
    return checked.where(F.col("_rows") >= min_rows).drop("_rows")


class LeakageError(ValueError):
    """A training row lies after the anchor, or the test date isn't after it."""


def assert_no_leakage(training: DataFrame, **options) -> None:
    """Raise LeakageError if :func:`leakage_report` has a row that isn't clean."""
    bad = leakage_report(training, **options).where("NOT clean").limit(1).collect()
    if bad:
        raise LeakageError(f"training data reaches beyond the anchor: {bad[0].asDict()}")
