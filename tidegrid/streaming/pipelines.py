"""Structured Streaming forms of the batch operators that have one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.functions.classes import SPIKE, hybrid_alert
from tidegrid.operators.joins import delayed_month_join
from tidegrid.runtime import discard_at_end, shared_dir


def weekly_max_stream(rows: DataFrame, *, site: str, moment: str, value: str, lateness: str = "28 days") -> DataFrame:
    """(site, week, value): the largest value per site and week from Monday; later rows than ``lateness`` are left out."""
    timed = rows.select(F.col(site).alias("site"), F.col(moment).cast("timestamp").alias("t"), F.col(value).alias("value")).withWatermark("t", lateness)
    # windows are aligned to the epoch, a Thursday
    week = F.window("t", "7 days", "7 days", "4 days")
    return timed.groupBy(week, "site").agg(F.max("value").alias("value")).select("site", F.to_date("window.start").alias("week"), "value")


def alert_stream(rows: DataFrame, *, probability: str, prediction: str) -> DataFrame:
    """The rows with the hybrid alert, without state."""
    return rows.withColumn("spike_alert", hybrid_alert(F.col(probability), F.col(prediction)))


_OUT = "site string, t timestamp, value double, last_observed double, days_since_spike double"
_STATE = "last_observed double, spike_at timestamp"


def delayed_month_stream(rows: DataFrame, index: DataFrame, *, moment: str, month: str, months_back: int, payload: Sequence[str]) -> DataFrame:
    """The rows with the payload of the static index for the month that lies ``months_back`` before their own, without state.

    See :func:`delayed_month_join`; the index is read anew for each batch.
    """
    return delayed_month_join(rows, index, day=moment, month=month, months_back=months_back, payload=payload)


def persistence_stream(rows: DataFrame, *, site: str, moment: str, value: str) -> DataFrame:
    """Each reading with the last value before it and the days since the last spike, kept as state per site.

    State is two numbers per site. Readings of a batch are taken in order of time and value; one that
    comes in a later batch than its successors sees the state that these left. A batch's readings
    of one site are held in memory together: ``maxFilesPerTrigger`` of the source bounds them.
    """

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, spike = state.get if state.exists else (None, None)
        pdf = pd.concat(frames).sort_values(["t", "value"]).reset_index(drop=True)
        spiked = pdf["t"].where(pdf["value"] > SPIKE).ffill()
        known = pdf["value"].ffill()
        before = known.shift().astype(float)
        spiked_before = spiked.shift()
        if last is not None:
            before = before.fillna(last)
        if spike is not None:
            spiked_before = spiked_before.fillna(pd.Timestamp(spike))
        end, end_spike = known.iloc[-1], spiked.iloc[-1]
        state.update((last if pd.isna(end) else float(end), spike if pd.isna(end_spike) else end_spike.to_pydatetime()))
        ages = (pdf["t"] - spiked_before).dt.total_seconds() / 86400
        yield pd.DataFrame({"site": key[0], "t": pdf["t"], "value": pdf["value"], "last_observed": before, "days_since_spike": ages})

    timed = rows.select(F.col(site).alias("site"), F.col(moment).cast("timestamp").alias("t"), F.col(value).cast("double").alias("value"))
    return timed.groupBy("site").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """All available input through a stream that appends, into Parquet files in the shared folder, which are read back."""
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{name}"
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    discard_at_end(spark, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_updates(stream: DataFrame, name: str, keys: Sequence[str], value: str) -> DataFrame:
    """All available input through a stream whose groups are updated, of which each group's largest value is read back.

    Every batch writes the groups it changed, replacing what an attempt before may have left, so state past
    the watermark is dropped and nothing is collected.
    """
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    discard_at_end(spark, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").groupBy(*keys).agg(F.max(value).alias(value))
