"""Results kept between queries: expiring entries, load-or-run tables, the listing of files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.runtime import discard_at_end, shared_dir

TTL_DAYS = 7


def with_expiry(entries: DataFrame, written: str, days: int = TTL_DAYS) -> DataFrame:
    """Adds expires_at."""
    return entries.withColumn("expires_at", F.col(written) + F.make_dt_interval(days=F.lit(days)))


def live(entries: DataFrame, now: str, pattern: str = "*") -> DataFrame:
    """The entries not yet expired whose key fits a pattern with ``*`` for any text."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return entries.where((F.col("expires_at") > F.lit(now).cast("timestamp")) & F.col("key").like(escaped))


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """``entries`` with those of ``new`` in place of entries of the same key."""
    return entries.join(new.select("key"), "key", "left_anti").unionByName(new)


def drop_matching(entries: DataFrame, pattern: str) -> DataFrame:
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return entries.where(~F.col("key").like(escaped))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))


def _stored(config: dict) -> str:
    return "result-" + hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:24]


def load_or_run(
    spark: SparkSession, config: dict, run: Callable[[], DataFrame], *, root: str | None = None, refresh: bool = False, keep: bool = True
) -> DataFrame:
    """The table stored for this configuration; if there is none, or to refresh it, ``run`` is run and stored.

    Without ``keep`` what is stored goes with the session.
    """
    path = f"{(root or shared_dir(spark)).rstrip('/')}/{_stored(config)}"
    if refresh or not _exists(spark, path):
        run().write.mode("overwrite").parquet(path)
        if not keep:
            discard_at_end(spark, path)
    return spark.read.parquet(path)


def tiered(spark: SparkSession, config: dict, run: Callable[[], DataFrame], roots: Sequence[str]) -> DataFrame:
    """The table stored for this configuration in the first root that has it, the fastest first; if none has, it is run.

    What is found or run is written through to all roots before the one it came from.
    """
    name = _stored(config)
    held = next((i for i, root in enumerate(roots) if _exists(spark, f"{root.rstrip('/')}/{name}")), None)
    found = run() if held is None else spark.read.parquet(f"{roots[held].rstrip('/')}/{name}")
    for root in reversed(roots[:held]):
        found.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")
        found = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    return found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files under a path, without reading them."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return listing.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
