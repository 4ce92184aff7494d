"""The session-level services on small frames."""

from pyspark.sql import functions as F

from tidegrid import runtime


def test_a_bit_map_keeps_all_members_and_few_others(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit("clash").alias("word"))
    keys = spark.range(0, 20_000, 40).select("id")
    kept = {r["k"] for r in runtime.possibly_in(df, "k", keys, 500).collect()}
    assert kept >= set(range(0, 20_000, 40)) and len(kept) < 4_000
    assert runtime.possibly_in(df, "k", keys.limit(0), 0).count() == 0
    assert runtime.possibly_in(df.limit(0), "k", keys, 500).columns == ["k", "word"]


def test_sizes_are_checked_before_a_broadcast(spark):
    df = spark.range(10)
    assert runtime.fits(df, 10) and not runtime.fits(df, 9)
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(runtime.bounded_broadcast(df, 10)) and not hinted(runtime.bounded_broadcast(df, 9))
    assert not hinted(runtime.bounded_broadcast(df, 100, F.lit(50))) and hinted(runtime.bounded_broadcast(df, 600, F.lit(50)))


def test_written_tables_have_no_lineage(spark):
    written = runtime.materialise(spark.range(5).withColumn("x", F.col("id") * 2), "test")
    assert written.columns == ["id", "x"] and written.count() == 5 and len(written.inputFiles()) >= 1
