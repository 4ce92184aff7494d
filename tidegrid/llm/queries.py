"""The queries of the llm problems, over their whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.scalars import count_value, settled, site_key
from tidegrid.llm.leakage import leaks
from tidegrid.llm.nearest_time import nearest_in_time
from tidegrid.llm.packing import pack_texts
from tidegrid.llm.spans import shared_groups, shared_lengths, shared_pairs
from tidegrid.plans.problems import usable_samples
from tidegrid.runtime import table

CAPACITY = 2048
SPAN = 300
WINDOW = 12


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "pn_counts").select("pn_id", "sampled_at", site_key(F.col("site")).alias("site_key"))
    return nearest_in_time(
        counts, usable_samples(spark, sf_dir), by="site_key", left_time="sampled_at", left_id="pn_id",
        right_time="collect_date", right_id="sample_id", tolerance_seconds=24 * 3600,
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select(F.col("left_id").alias("pn_id"), F.col("right_id").alias("sample_id"))


def p5_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with both measurements and the hours between them."""
    counts = table(spark, sf_dir, "pn_counts").select("pn_id", count_value(F.col("pn_count")).alias("cells"))
    samples = usable_samples(spark, sf_dir).select("sample_id", "result")
    pairs = _nearest(spark, sf_dir).withColumnsRenamed({"left_id": "pn_id", "right_id": "sample_id"})
    return pairs.join(counts, "pn_id").join(samples, "sample_id").select(
        "pn_id", "sample_id", settled(F.col("gap_seconds") / 3600).alias("gap_hours"), "cells", "result"
    )


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), capacity=CAPACITY)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each container holds."""
    packed = pack_texts(table(spark, sf_dir, "documents"), capacity=CAPACITY).where("container_id IS NOT NULL")
    return packed.groupBy("container_id").agg(
        F.count("*").alias("pieces"), F.sum("n_tokens").alias("n_tokens"), (F.lit(CAPACITY) - F.sum("n_tokens")).alias("unused")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), size=WINDOW)
    return found.select("doc_id", "item_id")


def p7_reworded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with items whose numbers, names or units were replaced one for one, and verbatim ones, by windows of each kind."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), size=WINDOW, verbatim=False)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_pairs(table(spark, sf_dir, "documents"), span=SPAN)


def p8_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of documents that p8_found gives the pairs of."""
    return shared_groups(table(spark, sf_dir, "documents"), span=SPAN)


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared_lengths(table(spark, sf_dir, "documents"), span=SPAN)
    return found.withColumn("shared_share", settled(F.col("shared_share")))


QUERIES = {f.__name__: f for f in (p5_found, p5_paired, p6_pack, p6_containers, p7_found, p7_reworded, p8_found, p8_groups, p8_shared)}
