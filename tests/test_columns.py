import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import aggregates as A
from tidegrid.operators import columns as K


def test_columns(spark):
    df = spark.createDataFrame([("copalis", "1.5", "x"), ("b", "inf", None)], "site string, a string, b string")
    assert [tuple(r) for r in K.coerce_numbers(df, ["site"]).collect()] == [("copalis", 1.5, None), ("b", None, None)]
    assert K.align(spark.createDataFrame([(None,)], "a double"), ["z", "a"], 7.0).first() == (7.0, 7.0)
    with pytest.raises(ValueError):
        K.rename(df, {"none": "x"})
    assert K.resolve(["Date", "Pseudo-nitzschia TOTAL"], ["pseudo", "nitzschia"]) == "Pseudo-nitzschia TOTAL" and K.resolve([], ["x"]) is None
    weights = {r["site"]: (r["boosted_weight"], r["forest_weight"]) for r in K.site_settings(df.select("site")).collect()}
    assert weights == {"copalis": (0.0, 1.0), "b": (0.56, 0.44)}
    maps = df.select("site", F.create_map(F.lit("p"), F.lit(1.0), F.lit("q"), F.lit(2.0)).alias("m"))
    assert {r["site"]: r["m"] for r in K.keep_site_features(maps, "m", {"b": ["p"]}).collect()} == {"copalis": {"p": 1.0, "q": 2.0}, "b": {"p": 1.0}}
    assert [e["key"] for e in maps.select(K.sorted_entries("m").alias("e")).first()["e"]] == ["q", "p"]


def test_summaries_on_empty_and_null(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0), (None, 4.0)], "k string, v double")
    assert {r["k"]: r["m"] for r in A.mean_by(df, ["k"], "v", "m").collect()} == {"a": 2.0, None: 4.0}
    assert A.drop_empty_columns(df.where("v IS NULL")).columns == ["k"]
    assert A.balanced_weights(df, "k").collect()[0]["weight"] == 1.0
    assert A.min_max(df, "v", "k").where("k = 'a'").agg(F.max("scaled")).first()[0] == 0.0
    assert A.correlation_matrix(df.select("v").limit(0)).first()["r"] is None
    assert A.gradient_band(spark.createDataFrame([(1.0, 1.0, 1.0)], "q50 double, lo double, hi double"), 30).count() == 30


def test_exact_quantile(spark, monkeypatch):
    monkeypatch.setattr(A, "CLOSE_VALUES", 20)
    rng = np.random.default_rng(2)
    for values in (rng.normal(0, 1, 5000), np.repeat([1.0, 2.0], 4000), np.append(np.zeros(3000), rng.random(900)), np.array([3.0]), rng.random(2)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        for q in (0.0, 0.25, 0.5, 0.99, 1.0):
            assert abs(A.exact_quantile(df, "x", q) - np.quantile(values, q)) < 1e-12
    assert A.exact_quantile(df.limit(0), "x") is None


@pytest.mark.parametrize("at_once", [1_000, 1])
def test_inverse_distance(spark, monkeypatch, at_once):
    monkeypatch.setattr(A, "TARGETS", at_once)
    grid = spark.createDataFrame([(1, 10.0, 2.0), (1, 12.0, 4.0), (1, 13.0, None)], "p int, lat double, v double")
    targets = spark.createDataFrame([("exact", 10.0), ("between", 11.0)], "site string, l double")
    got = {r["site"]: r["interpolated"] for r in A.inverse_distance(grid, targets, period="p", lat="lat", value="v", target="site", target_lat="l").collect()}
    assert got["exact"] == 2.0 and abs(got["between"] - 3.0) < 1e-6
