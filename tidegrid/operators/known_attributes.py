"""Attributes as known at event time: each event with the entry that held then and was on record.

An entry can be used from the day on which it holds and is on record. The entity's entry of
highest rank changes only on such days, so successive change days give validity intervals
[from, to); these are exploded into buckets of days and met by the events in an equi-join on
entity and bucket with half-open containment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.runtime import materialise

#: Length of a time bucket in days.
BUCKET_DAYS = 91
#: Buckets of the events after the last change.
LATE_BUCKETS = 64


def validity_intervals(
    entries: DataFrame, entity: str, valid_from: str, known_at: str, version: str, payload: Sequence[str] = ()
) -> DataFrame:
    """(entity, version, *payload, from_day, to_day): when an entry is the one to be used.

    Days are counted from 1970-01-01; ``to_day`` is excluded and NULL for the last interval.
    Of the entries that hold and are on record by 00:00 of a day, the one with the latest
    ``valid_from``, then the latest ``known_at``, then the largest version counts. Entries
    with a NULL entity, date or time are never used; repeated ones make no difference.
    """
    rank = F.struct(F.col(valid_from).alias("v"), F.col(known_at).alias("k"), F.col(version).alias("id"))
    day_known = F.unix_date(F.to_date(known_at)) + (F.col(known_at) > F.to_date(known_at)).cast("int")
    usable = entries.dropna(subset=[entity, valid_from, known_at, version]).select(
        F.col(entity).alias("entity"), rank.alias("rank"), F.struct(*payload).alias("payload") if payload else F.lit(None).alias("payload"),
        F.greatest(F.unix_date(F.to_date(valid_from)), day_known).alias("day"),
    )
    # per entity and change day the best entry that begins to be usable, then the best so far
    changes = usable.groupBy("entity", "day").agg(F.max("rank").alias("rank"), F.max_by("payload", "rank").alias("payload"))
    so_far = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    held = changes.select(
        "entity", "day", F.max_by(F.struct("rank", "payload"), "rank").over(so_far).alias("best"),
    )
    by_day = Window.partitionBy("entity").orderBy("day")
    turns = held.withColumn("before", F.lag("best.rank").over(by_day)).where(~F.col("before").eqNullSafe(F.col("best.rank")))
    return turns.select(
        "entity", F.col("best.rank.id").alias("version"), *[F.col(f"best.payload.{c}").alias(c) for c in payload],
        F.col("day").alias("from_day"), F.lead("day").over(by_day).alias("to_day"),
    )


def join_known(
    events: DataFrame, entity: str, event_date: str, intervals: DataFrame, bucket_days: int = BUCKET_DAYS
) -> DataFrame:
    """The columns of ``events`` and those of the interval (entity aside) that contains the event date.

    Events without entity, date or interval don't appear. Each event meets at most one interval;
    repeated events are all kept. Columns of the events may have any names: those of the
    intervals are put into the struct ``known``.

    The intervals are written once. Both sides are hashed on entity and bucket: an entity with many
    events is spread over its buckets. Events past the bucket of the last change are spread over
    LATE_BUCKETS more by a hash of their columns, to which the intervals that are still open are copied.
    """
    intervals = materialise(intervals, "intervals")
    last = intervals.agg(F.floor(F.max("from_day") / bucket_days).cast("int")).first()[0]
    horizon = F.lit(0 if last is None else last)
    plain = lambda day: F.floor(day / bucket_days).cast("int")
    end = F.when(F.col("to_day").isNull(), horizon + LATE_BUCKETS).otherwise(plain(F.col("to_day") - 1))
    spread = intervals.select(
        F.col("entity").alias("_entity"), F.struct(*[c for c in intervals.columns if c != "entity"]).alias("known"),
        F.explode(F.sequence(plain(F.col("from_day")), end)).alias("_bucket"),
    )
    hashed = [F.col(c) for c, kind in events.dtypes if "map<" not in kind and "variant" not in kind]
    late = horizon + 1 + F.pmod(F.xxhash64(*hashed), F.lit(LATE_BUCKETS)).cast("int")
    bucket_of = lambda day: F.when(plain(day) > horizon, late).otherwise(plain(day))
    day = F.unix_date(F.to_date(event_date))
    dated = events.where(F.col(entity).isNotNull() & F.col(event_date).isNotNull()).withColumns(
        {"_entity": F.col(entity), "_day": day, "_bucket": bucket_of(day)}
    )
    inside = (F.col("_day") >= F.col("known.from_day")) & (F.col("known.to_day").isNull() | (F.col("_day") < F.col("known.to_day")))
    return dated.join(spread, ["_entity", "_bucket"]).where(inside).drop("_entity", "_bucket", "_day")
