"""Leak-free features, joins and training windows on small series with known values."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators.joins import LeakageError, assert_no_leakage, asof_join, delayed_month_join, training_windows
from tidegrid.operators.series import lattice, on_lattice, weekly_max
from tidegrid.operators.windows import decay_fill, hashed_sample, history_counts, observation_lags, persistence, rolling_past

START = date(2020, 1, 6)
VALUES = [1, None, 3, None, 25, None, None, 2]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([("A", START + timedelta(weeks=i), float(v) if v is not None else None) for i, v in enumerate(VALUES)], "site string, week date, da_raw double")


def column(df, name):
    return [None if r[name] is None else round(r[name], 6) for r in df.orderBy("site", "week").collect()]


def test_golden_features(golden):
    rows = observation_lags(rolling_past(persistence(golden)))
    assert column(rows, "last_observed") == [1, 1, 3, 3, 25, 25, 25, 2]
    assert column(rows, "weeks_since_spike") == [999, 999, 999, 999, 0, 1, 2, 3]
    assert column(rows, "roll_mean_4") == [None, 1, 1, 1.666667, 2, 8, 14, 19.5]
    assert column(rows, "roll_std_4") == [None, None, 0, 1.154701, 1.154701, 11.372481, 12.701706, 11]
    assert column(rows, "roll_max_4") == [None, 1, 1, 3, 3, 25, 25, 25]
    assert column(rows, "prev_obs_1") == [None, 1, 1, 3, 3, 25, 25, 25]
    assert column(rows, "prev_obs_2") == [None, None, None, 1, 1, 3, 3, 3]
    assert column(rows, "prev_obs_3") == [None] * 5 + [1, 1, 1]
    assert column(rows, "prev_obs_4") == [None] * 8
    assert column(rows, "prev_obs_2_weeks") == [None, None, None, 3, 4, 3, 4, 5]
    assert column(decay_fill(golden, "da_raw", 0.2, name="f"), "f") == [1, 0.818731, 3, 2.456192, 25, 20.468269, 16.758001, 2]
    assert column(decay_fill(golden, "da_raw", 0.2, max_gap=1, name="f"), "f") == [1, 0.818731, 3, 2.456192, 25, 20.468269, 0, 2]


def test_features_never_see_the_future(spark, golden):
    changed = golden.withColumn("da_raw", F.when(F.col("week") > START + timedelta(weeks=4), F.lit(77.0)).otherwise(F.col("da_raw")))
    make = lambda df: observation_lags(rolling_past(persistence(df))).where(F.col("week") <= START + timedelta(weeks=4)).orderBy("week").collect()
    assert make(golden) == make(changed)


def test_weekly_and_lattice(spark):
    raw = spark.createDataFrame([("A", date(2021, 1, 1), 3.0), ("A", date(2020, 12, 28), 5.0), ("B", date(2021, 1, 4), 1.0)], "site string, date date, da_raw double")
    assert sorted((r[0], str(r[1]), r[2]) for r in weekly_max(raw).collect()) == [("A", "2020-12-28", 5.0), ("B", "2021-01-04", 1.0)]
    weeks = lattice(raw)
    assert weeks.count() == 2 * 1095 and weeks.agg(F.min("week"), F.max("week")).first() == (date(2003, 1, 6), date(2023, 12, 25))
    assert on_lattice(weekly_max(raw)).where("da_raw IS NOT NULL").count() == 2


def test_asof_against_loop(spark):
    rng = np.random.default_rng(0)
    base = datetime(2020, 1, 1)
    left = [(i, ["a", "b", None][rng.integers(3)], base + timedelta(hours=int(rng.integers(0, 24 * 700)))) for i in range(200)]
    right = [(["a", "b", None][rng.integers(3)], base + timedelta(hours=int(rng.integers(0, 24 * 700))), float(i) if i % 5 else None) for i in range(60)]
    a = spark.createDataFrame(left, "id long, k string, t timestamp")
    b = spark.createDataFrame(right, "k string, u timestamp, v double")
    for strict, tolerance, delay in ((False, 7, 0), (True, None, 0), (False, None, 3), (False, 28, 7)):
        got = {r["id"]: (r["matched_on"], r["v"]) for r in asof_join(a, b, by=["k"], left_on="t", right_on="u", payload=["v"], tolerance_days=tolerance, delay_days=delay, strict=strict).collect()}
        assert len(got) == len(left)
        for i, k, t in left:
            cut = t - timedelta(days=delay)
            fit = [(u, v) for kk, u, v in right if k is not None and kk == k and (u < cut if strict else u <= cut)]
            best = max(fit, key=lambda x: (x[0], x[1] is not None, x[1] or 0), default=(None, None))
            if best[0] is not None and tolerance is not None and cut - best[0] > timedelta(days=tolerance):
                best = (None, None)
            assert got[i] == best


def test_asof_tolerance_is_inclusive_and_empty_side(spark):
    a = spark.createDataFrame([(1, "a", date(2020, 1, 8)), (2, "a", date(2020, 1, 9))], "id long, k string, t date")
    b = spark.createDataFrame([("a", date(2020, 1, 1), 5.0)], "k string, u date, v double")
    options = dict(by=["k"], left_on="t", right_on="u", payload=["v"], tolerance_days=7)
    assert {r["id"]: r["v"] for r in asof_join(a, b, **options).collect()} == {1: 5.0, 2: None}
    assert [r["v"] for r in asof_join(a, b.limit(0), **options).collect()] == [None, None]
    assert asof_join(a.limit(0), b, **options).count() == 0


def test_month_join(spark):
    left = spark.createDataFrame([(date(2020, 3, 31),), (None,)], "d date")
    index = spark.createDataFrame([(date(2020, 1, 15), 1.0), (date(2020, 1, 1), 2.0)], "m date, v double")
    assert sorted(str(r["v"]) for r in delayed_month_join(left, index, day="d", month="m", months_back=2, payload=["v"]).collect()) == ["2.0", "None"]


@pytest.fixture(scope="module")
def weeks(spark):
    return spark.createDataFrame([(s, date(2015, 1, 5) + timedelta(weeks=i), float(i)) for s in ("A", "B") for i in range(20)], "site string, week date, da_raw double")


def test_training_windows(spark, weeks):
    anchor = date(2015, 1, 5) + timedelta(weeks=12)
    anchors = spark.createDataFrame([("A", anchor, anchor + timedelta(days=7)), ("B", date(2015, 1, 12), date(2015, 1, 19))], "site string, anchor date, test_date date")
    rows = training_windows(anchors, weeks)
    assert {r[0] for r in rows.select("site").distinct().collect()} == {"A"}
    assert rows.count() == 13 and rows.agg(F.max("week")).first()[0] == anchor
    assert_no_leakage(rows, keys=["site"])


@pytest.mark.parametrize("week,test,clean", [("2015-06-01", "2015-07-01", True), ("2015-06-07", "2015-07-01", True), ("2015-06-14", "2015-07-01", False), ("2015-06-01", "2015-06-07", False), ("2015-06-01", "2015-05-01", False)])
def test_leakage_guard(spark, week, test, clean):
    df = spark.createDataFrame([("A", week, "2015-06-07", test)], "site string, week string, anchor string, test_date string")
    df = df.select("site", *[F.col(c).cast("date").alias(c) for c in ("week", "anchor", "test_date")])
    if clean:
        assert_no_leakage(df, keys=["site"])
    else:
        with pytest.raises(LeakageError):
            assert_no_leakage(df, keys=["site"])


def test_sample_and_history(spark, weeks):
    drawn = hashed_sample(weeks, group="site", key=["site", "week"], fraction=0.33, seed=1)
    assert {r["site"]: r["count"] for r in drawn.groupBy("site").count().collect()} == {"A": 7, "B": 7}
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, hashed_sample(weeks.repartition(3), group="site", key=["site", "week"], fraction=0.33, seed=1).collect()))
    counted = history_counts(weeks.unionByName(weeks), "week", 7)
    assert {(r["week"] - date(2015, 1, 5)).days // 7 * 2 == r["n_history"] for r in counted.collect()} == {True}


def test_lattice_is_never_broadcast(spark, weeks):
    # the filter makes the join an inner one, whose lattice looks as small as the sites before they are exploded
    rows = on_lattice(weeks).where("da_raw IS NOT NULL")
    assert len(rows.collect()) == weeks.count()
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
