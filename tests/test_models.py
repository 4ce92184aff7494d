"""Learners, spectra, metrics and the backtest against direct computation."""

import json
import threading
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.config import GRID, SITES, BoostSettings, EngineConfig, ForestSettings
from tidegrid.functions import classes as C
from tidegrid.operators import experiments, metrics, spectral, trees
from tidegrid.operators.trees import Boosted, BoostedClasses, Forest, Ridge, Scaler, Shared, Softmax, TreeSettings, boosted_shared
from tidegrid.plans import backtest, base, registry

RNG = np.random.default_rng(0)

def small(rounds=10, trees=5, **changes):
    """A configuration of small learners, at single sites too."""
    fewer = BoostSettings(rounds=rounds, depth=3)
    base = EngineConfig(boosted=fewer, forest=ForestSettings(trees=trees, depth=4), spikes=fewer, classes=fewer, bootstrap_rounds=5, test_fraction=0.1)
    return base.at_sites(boosted=None, forest=None).but(**changes)


SMALL = small()


def test_ridge_is_the_closed_form():
    x, y = RNG.random((50, 3)), RNG.random(50)
    model = Ridge(1.0).fit(x, y)
    a = x - x.mean(axis=0)
    assert np.allclose(model.coefficients, np.linalg.inv(a.T @ a + np.eye(3)) @ a.T @ (y - y.mean()))


def test_trees_learn_and_respect_direction():
    x = RNG.random((600, 3))
    y = np.where(x[:, 0] > 0.5, 10.0, 0.0) + x[:, 1] + RNG.normal(0, 0.1, 600)
    for model in (Boosted(60, 0.1, settings=TreeSettings(depth=3)), Forest(20, TreeSettings(depth=6, l2=0.0, min_weight=3, columns=0.85))):
        model.fit(x[:400], y[:400])
        error = y[400:] - model.predict(x[400:])
        assert 1 - error.var() / y[400:].var() > 0.9
        assert model.importance().argmax() == 0 and abs(model.importance().sum() - 1) < 1e-9
    rising = Boosted(40, 0.1, settings=TreeSettings(depth=3, monotone=(0, 1, 0))).fit(x, RNG.random(600) - x[:, 1])
    line = np.tile(x[:1], (30, 1))
    line[:, 1] = np.linspace(0, 1, 30)
    assert (np.diff(rising.predict(line)) >= -1e-12).all()


def test_a_forest_at_a_point_is_the_forest():
    x = RNG.random((300, 5))
    x[::9, 2] = np.nan
    y = np.where(x[:, 0] > 0.5, 10.0, 0.0) + 3 * x[:, 1] + RNG.normal(0, 1, 300)
    for settings in (TreeSettings(depth=12, l2=0.0, min_weight=3, min_split=5, columns=0.6), TreeSettings(depth=3, l2=0.0, min_weight=1)):
        forest = Forest(90, settings, seed=7)
        whole = forest.fit(x, y)
        assert all(abs(whole.predict(x[i : i + 1])[0] - forest.predict_at(x, y, x[i])) < 1e-9 for i in range(0, 300, 37))


def test_rows_without_weight_and_blocks_change_nothing(monkeypatch):
    x = RNG.random((400, 4))
    binner = trees.Binner.fit(x)
    bins, cells = binner(x), binner.cells()
    g, h = RNG.normal(0, 1, 400), (RNG.random(400) < 0.8).astype(float)
    settings = TreeSettings(depth=5, columns=0.7, tree_columns=0.9)
    whole, at = trees.grow(bins, g * h, h, settings, cells, 3, 1)
    assert (whole.leaves(bins) == at).all()
    part, _ = trees.grow(bins[h > 0], g[h > 0], h[h > 0], settings, cells, 3, 1)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 17)
    blocks, _ = trees.grow(bins, g * h, h, settings, cells, 3, 1)
    monkeypatch.setattr(trees, "SUBTRACT_ROWS", 1)
    subtracted, _ = trees.grow(bins, g * h, h, settings, cells, 3, 1)
    for other in (part, blocks, subtracted):
        # columns that part a node's rows in the same way may stand for each other
        assert len(other.value) == len(whole.value) and np.allclose(other.predict(bins)[h > 0], whole.predict(bins)[h > 0])


@pytest.mark.parametrize("kind", [{}, {"quantile": 0.9}, {"logistic": True}])
def test_models_side_by_side_are_those_alone(kind):
    learner = Boosted(12, 0.1, settings=TreeSettings(depth=4, columns=0.7, tree_columns=0.8, monotone=(1, 0, 0)), subsample=1.0, **kind)
    parts = []
    for n in (90, 300, 140):
        x = RNG.random((n, 3))
        x[::11, 1] = np.nan
        x[:, 2] = np.round(x[:, 2] * n / 100)
        y = x[:, 0] * 10 + RNG.normal(0, 1, n)
        parts.append((x, (y > 5).astype(float) if "logistic" in kind else y, RNG.random(n) + 0.5, RNG.random((4, 3))))
    for (x, y, w, points), (found, share) in zip(parts, learner.predict_many(parts)):
        alone = learner.fit(x, y, w)
        assert np.allclose(found, alone.predict(points)) and np.allclose(share, alone.importance())


def test_quantiles_and_classes():
    x = RNG.random((600, 3))
    y = 10 * x[:, 0] + RNG.normal(0, 1 + x[:, 0], 600)
    below = [(y < Boosted(80, 0.1, settings=TreeSettings(depth=3), quantile=q).fit(x, y).predict(x)).mean() for q in (0.05, 0.5, 0.95)]
    assert np.allclose(below, [0.05, 0.5, 0.95], atol=0.06)
    classes = np.where(x[:, 0] > 0.7, 3, np.where(x[:, 0] > 0.3, 1, 0))
    slots = BoostedClasses(40, 0.2, settings=TreeSettings(depth=2)).fit(x, classes).slots(x, range(4))
    assert np.allclose(slots.sum(axis=1), 1) and (slots[:, 2] == 0).all() and (slots.argmax(axis=1) == classes).mean() > 0.95


def test_logistic_softmax_and_missing_values():
    x = RNG.random((400, 2))
    y = (x[:, 0] > 0.6).astype(float)
    x[::7, 1] = np.nan
    assert ((Boosted(40, 0.2, settings=TreeSettings(depth=2), logistic=True).fit(x, y).predict(x) > 0.5) == y).mean() > 0.95
    scaled = Scaler().fit(x)(x)
    assert scaled.min() == 0 and scaled.max() == 1
    slots = Softmax().fit(scaled, (y * 3).astype(int)).slots(scaled, range(4))
    assert np.allclose(slots.sum(axis=1), 1) and (slots[:, 1:3] == 0).all() and ((slots[:, 3] > 0.5) == y).mean() > 0.9


def test_spectra_find_a_period(spark):
    t = np.arange(400)
    x = np.sin(2 * np.pi * t / 20)
    f, p = spectral.periodogram(x)
    assert abs(1 / f[p.argmax()] - 20) < 1e-9 and abs(p.sum() / len(t) - x.var()) < 1e-9
    f, p = spectral.welch(x)
    assert abs(1 / f[p.argmax()] - 20) < 1
    assert spectral.welch(x[:19])[0].size == 0 and spectral.spectrogram(x[:31])[0].size == 0
    f, c = spectral.coherence(x + RNG.normal(0, 0.1, 400), x)
    assert 0 <= c.min() and c.max() <= 1 + 1e-9 and c[np.abs(f - 0.05).argmin()] > 0.95
    rows = [("a", date(2010, 1, 4) + timedelta(weeks=int(i)), float(v)) for i, v in enumerate(x)] + [("b", date(2010, 1, 4), 1.0)]
    df = spark.createDataFrame(rows, "site string, week date, value double")
    best = spectral.dominant_periods(spectral.spectra(df, "welch")).collect()
    assert [r["site"] for r in best] == ["a"] and abs(best[0]["periods"][0] - 20) < 1


def test_bootstrap_is_independent_of_partitions_and_covers(spark):
    a = RNG.gamma(2, 5, 400)
    pdf = pd.DataFrame({"id": np.arange(400), "a": a, "p": a + RNG.normal(0, 2, 400), "q": a + RNG.normal(0, 4, 400)})
    df = spark.createDataFrame(pdf)
    run = lambda x: {(r["model"], r["metric"]): tuple(None if r[c] is None else round(r[c], 9) for c in ("low", "mid", "high")) for r in metrics.bootstrap_intervals(x, key="id", actual="a", models=["p", "q"], replicates=200).collect()}
    one = run(df)
    assert one == run(df.repartition(3))
    # a model's gaps cost the other nothing but where both are compared
    holes = df.withColumn("q", F.when(F.col("id") % 3 > 0, F.col("q")))
    part = run(holes)
    assert part["p", "mae"] == one["p", "mae"] and part["p", "r2"] == one["p", "r2"] and part["q", "mae"] == run(holes.where("q IS NOT NULL"))["q", "mae"]
    assert part["q", "delta_r2"] == run(holes.where("q IS NOT NULL"))["q", "delta_r2"] and run(df.withColumn("q", F.lit(None).cast("double")))["q", "r2"] == (None,) * 3
    low, mid, high = one["p", "mae"]
    assert low < np.abs(pdf["p"] - a).mean() < high and one["q", "delta_r2"][0] > 0


def test_boundaries(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 5.0, 12.0, 20.0, 40.0, 40.01, None)], "x double")
    x = F.col("x")
    rows = df.select(C.category_right_closed(x), C.category_left_closed(x), C.is_spike(x, False), C.is_spike(x), C.hybrid_alert(F.lit(None).cast("double"), x)).collect()
    assert [tuple(r) for r in rows] == [
        (0, 0, False, False, False), (0, 1, False, False, False), (1, 1, False, False, True), (1, 2, False, True, True),
        (2, 3, True, True, True), (3, 3, True, True, True), (None, None, None, None, None),
    ]


def test_event_and_class_metrics(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (None, True), (True, None)], "e boolean, a boolean")
    row = df.agg(*metrics.event_columns(F.col("e"), F.col("a"))).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["recall"], row["precision"]) == (1, 1, 1, 1, 0.5, 0.5)
    assert df.limit(0).agg(*metrics.event_columns(F.col("e"), F.col("a"))).first()["f2"] == 0
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, None)], "a int, p int")
    report = {r["category"]: r for r in metrics.class_report(pairs, "a", "p").collect()}
    assert report[0]["recall"] == 0.5 and report[1]["precision"] == 0.5 and report[2]["f1"] == 0 and len(report) == 4
    one = spark.createDataFrame([(1.0, 1.0), (1.0, None)], "actual double, predicted double")
    assert metrics.regression_metrics(one).first()["r2"] is None and metrics.regression_metrics(one).first()["n"] == 1


def test_linear_sensitivity(spark):
    x = RNG.random((300, 2))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": 3 * x[:, 0] - x[:, 1]}))
    got = {r["feature"]: r for r in experiments.linear_sensitivity(df, "y", ["a", "b"]).collect()}
    assert abs(got["a"]["slope"] - 3) < 1e-9 and abs(got["a"]["first_order"] + got["b"]["first_order"] - 1) < 1e-9


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(3)
    rows = [(s, date(2015, 1, 5) + timedelta(weeks=i), float(rng.gamma(1, 12))) for s in ("copalis", "other") for i in range(60) if rng.random() > 0.2]
    return spark.createDataFrame(rows, "site string, date date, da_raw double")


def test_supervised_rows_are_those_of_the_anchor(spark, raw):
    """Each week has its anchor row's features, its own calendar, and persistence recomputed from measurements up to the anchor."""
    frame = backtest.feature_frame(raw, None, SMALL)
    rows = {(r["site"], r["week"]): r for r in backtest.supervised(frame, SMALL).collect()}
    before = {(r["site"], r["week"]): r for r in frame.collect()}
    measured = {(r["site"], r["date"]): r["da_raw"] for r in raw.collect()}
    for (site, week), r in rows.items():
        anchor = week - timedelta(days=7)
        past = sorted((d, v) for (s, d), v in measured.items() if s == site and d <= anchor)
        spikes = [d for d, v in past if v > 20]
        assert r["last_observed"] == (past[-1][1] if past else None)
        assert abs(r["weeks_since_spike"] - ((week - spikes[-1]).days / 7 if spikes else 999)) < 1e-9
        assert r["month"] == week.month and abs(r["sin_day_of_year"] - np.sin(2 * np.pi * week.timetuple().tm_yday / 365)) < 1e-12
        assert all(r[c] == before[site, anchor][c] for c in ("prev_obs_1", "prev_obs_diff", "roll_max_4", "pn_log"))
    assert min(w for _, w in rows) - min(w for _, w in before) == timedelta(days=7)


def test_backtest(spark, raw):
    rows = backtest.retrospective(raw, None, SMALL).collect()
    assert rows and len({(r["site"], r["test_date"]) for r in rows}) == len(rows)
    for r in rows:
        assert (r["test_date"] - r["anchor"]).days == 7 and r["training_samples"] >= 10
        assert r["predicted"] == r["ensemble"] >= 0 and r["q05"] is None and r["class_probabilities"] is None
        assert r["predicted_category"] == np.searchsorted([5, 20, 40], r["ensemble"]) and r["actual_category"] == np.searchsorted([5, 20, 40], r["actual"])
    later = raw.withColumn("da_raw", F.when(F.col("date") > max(r["anchor"] for r in rows), 999.0).otherwise(F.col("da_raw")))
    again = {(r["site"], r["test_date"]): r["ensemble"] for r in backtest.retrospective(later, None, SMALL).collect()}
    assert all(abs(again[r["site"], r["test_date"]] - r["ensemble"]) < 1e-9 for r in rows if (r["site"], r["test_date"]) in again)


@pytest.mark.parametrize("model", ["logistic", "naive", "rf"])
def test_models_of_a_retrospective(spark, raw, model):
    for r in backtest.retrospective(raw, None, SMALL, model=model).collect():
        assert r["predicted"] == {"naive": r["naive"], "rf": r["forest"]}.get(model, r["ensemble"])
        assert (r["logistic_category"] is not None) == (model == "logistic") and (model != "logistic" or r["predicted_category"] == r["logistic_category"])


def test_summary(spark):
    rng = np.random.default_rng(4)
    a, p = rng.gamma(1, 15, 300), rng.gamma(1, 15, 300)
    a[:3], p[:3] = 20.0, [20.0, 20.0, 21.0]
    ac, pc = np.searchsorted([5, 20, 40], a), np.searchsorted([5, 20, 40], p)
    pdf = pd.DataFrame({"actual": a, "predicted": p, "actual_category": ac, "predicted_category": pc})
    got = backtest.summary(spark.createDataFrame(pdf)).first()
    both = ((a > 20) & (p > 20)).sum()
    recalls = [((ac == c) & (pc == c)).sum() / (ac == c).sum() for c in range(4)]
    assert abs(got["r2_score"] - (1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum())) < 1e-9 and abs(got["mae"] - np.abs(a - p).mean()) < 1e-9
    assert abs(got["f1_score"] - 2 * both / ((a > 20).sum() + (p > 20).sum())) < 1e-9 and got["total_forecasts"] == 300
    assert abs(got["accuracy"] - (ac == pc).mean()) < 1e-9 and abs(got["balanced_accuracy"] - np.mean(recalls)) < 1e-9
    assert got["extreme_support"] == (ac == 3).sum() and abs(got["low_recall"] - recalls[0]) < 1e-9
    assert backtest.summary(spark.createDataFrame(pdf).limit(0)).first()["total_forecasts"] == 0


def test_single_forecast_and_configuration(spark, raw):
    both = backtest.single_forecast(raw, None, "copalis", date(2016, 1, 4), SMALL, task="both").first()
    assert both["q05"] is not None and both["predicted"] == both["ensemble"] and abs(sum(both["class_probabilities"]) - 1) < 1e-6
    linear = backtest.single_forecast(raw, None, "copalis", date(2016, 1, 4), SMALL, task="classification", model="linear").first()
    assert linear["q05"] is None and linear["predicted"] == linear["linear"] and linear["logistic_category"] == int(np.argmax(linear["class_probabilities"]))
    assert backtest.single_forecast(raw, None, "copalis", date(2015, 2, 2), SMALL).count() == 0
    assert SMALL.but(per_site=False).site("copalis").forest_weight == 0.44
    assert EngineConfig().boosted_at("copalis") == BoostSettings(100, 2, 0.03, 10, 1.0, 5.0, 1.0, 0.7, 0.7, 0.8) and EngineConfig().boosted_at("x") == BoostSettings()
    assert EngineConfig().forest_at("newport") == ForestSettings(200, 6, 10, 5, 0.5)
    with pytest.raises(ValueError):
        EngineConfig(test_fraction=0)


def test_options_given_as_text():
    base = EngineConfig()
    found = base.with_options({
        "lags": "1,3", "per_site": "false", "clip_quantile": "none", "forest": '{"depth": 16, "trees": 600}', "features": "minimal", "drop_features": "month, pn_log",
        "holdout_from": "2019-01-01", "seed": "7", "test_fraction": "0.5",
    })
    assert (found.lags, found.per_site, found.clip_quantile, found.forest.trees, found.seed, found.test_fraction) == ((1, 3), False, None, 600, 7, 0.5)
    assert found.drop_features == ("month", "pn_log") and found.holdout_from == date(2019, 1, 1) and found.sites["kalaloch"].cap is None
    assert base.with_options({"lags": "none"}).lags == () and base.with_options({}) == base
    for wrong in ({"no_such": "1"}, {"lags": "0"}, {"per_site": "perhaps"}, {"clip_quantile": "2"}, {"features": "some"}, {"horizon_weeks": "0"}):
        with pytest.raises((ValueError, KeyError)):
            base.with_options(wrong)


def test_site_features_and_bounds(spark, raw):
    rows = backtest.training_frame(raw, None, SMALL).where("site = 'copalis'").toPandas()
    names = backtest.feature_columns(backtest.training_frame(raw, None, SMALL), SMALL)
    p = backtest.Training(rows, names, "copalis", date(2016, 1, 6), date(2015, 12, 30), SMALL)
    assert set(p.kept) == set(SITES["copalis"].features) & set(names) and p.cap == np.quantile(p.y, 0.97)
    assert p.at.shape == (1, len(p.kept)) and p.size == len(rows[rows["week"] <= date(2015, 12, 28)])
    with pytest.raises(ValueError):
        backtest.Training(rows, names, "copalis", date(2016, 1, 6), date(2016, 1, 6), SMALL)


def test_tuning_and_experiments(spark, raw):
    tiny = small(3, 2, bootstrap_rounds=0, test_fraction=0.15)
    anchors = backtest.calibration_anchors(backtest.test_anchors(raw, tiny.but(test_fraction=1.0)), tiny)
    assert {r["count"] for r in anchors.groupBy("site").count().collect()} <= set(range(1, 21))
    grid = ({"rounds": 3, "depth": 2}, {"rounds": 4, "rate": 0.2})
    best = backtest.tune(anchors, backtest.training_frame(raw, None, tiny), tiny, grid).collect()
    assert {r["site"] for r in best} == {"copalis", "other"} and all(json.loads(r["best"]) in grid for r in best)
    assert backtest.site_grids()["long beach"][:2] == SITES["long beach"].grid and backtest.site_grids()["clatsop beach"] == GRID
    runs = {n: c for n, c in backtest.ablations(tiny).items() if n in ("baseline", "no_lags")}
    scores = backtest.run_experiments(raw, None, runs).collect()
    assert {(r["experiment"], r["site"]) for r in scores} == {(e, s) for e in runs for s in (None, "copalis", "other")}
    assert len(backtest.seeded(tiny, (1, 2))) == 4


def test_tuning_runs_over_every_anchor(spark, sf, monkeypatch):
    """The registered tuning has every measured week with enough history, and no sample of at most 20 a site."""
    given = []
    monkeypatch.setattr(backtest, "tune", lambda anchors, rows: given.append(anchors) or spark.createDataFrame([], "site string, best string, r2 double"))
    registry.queries()["model14_tuned_sites"](spark, sf)
    found = sorted((r["site"], r["test_date"]) for r in given[0].collect())
    measured = base.raw(spark, sf).groupBy("site", F.to_date(F.date_trunc("week", "date")).alias("week"), "date").count().collect()
    days, expected = {}, []
    for r in measured:
        days.setdefault(r["site"], []).append((r["week"], r["date"], r["count"]))
    for site, rows in days.items():
        n = sum(k for _, _, k in rows)
        for week in {w for w, _, _ in rows}:
            first = min(d for w, d, _ in rows if w == week)
            if sum(k for _, d, k in rows if d <= first - timedelta(days=7)) >= max(np.ceil(0.33 * n), 10):
                expected.append((site, week))
    assert found == sorted(expected) and max(sum(s == site for s, _ in found) for site in days) > 20


def test_tuning_scores_are_those_of_all_anchors(spark, raw, monkeypatch):
    monkeypatch.setattr(backtest, "TUNED_A_TASK", 12)
    tiny, grid = small(3, 2), ({"rounds": 3, "depth": 2}, {"rounds": 6, "rate": 0.2})
    anchors = backtest.test_anchors(raw, tiny.but(test_fraction=1.0))
    rows = backtest.training_frame(raw, None, tiny)
    names, weeks, expected = backtest.feature_columns(rows, tiny), rows.toPandas(), {}
    asked = anchors.withColumn("hash", F.xxhash64("test_date")).toPandas()
    for site, own in asked.groupby("site"):
        tasks = int(np.ceil(len(own) / 12))
        assert len(own) > 20 and own["hash"].mod(tasks).nunique() > 1
        for changes in grid:
            tried, both = tiny.but(boosted=replace(tiny.boosted_at(site), **changes)), []
            of = weeks[weeks["site"] == site].sort_values("week")
            for _, some in own.groupby(own["hash"].mod(tasks)):
                pairs = [(a.actual, backtest.Training(of, names, site, a.test_date, a.anchor, tried)) for a in some.itertuples()]
                pairs = [(actual, p) for actual, p in pairs if p.usable]
                both += [(actual, p) for (actual, _), (p, _) in zip(pairs, backtest.boosted_together([p for _, p in pairs], monotone=True))]
            assert len(both) == len(own)
            actual, predicted = np.array(both).T
            r2 = 1 - ((actual - predicted) ** 2).sum() / ((actual - actual.mean()) ** 2).sum()
            expected[site] = max(expected.get(site, (-np.inf, "")), (r2, json.dumps(changes, sort_keys=True)))
    got = {r["site"]: (r["r2"], r["best"]) for r in backtest.tune(anchors, rows, tiny, grid).collect()}
    assert got.keys() == expected.keys() and all(got[s][1] == best and abs(got[s][0] - r2) < 1e-9 for s, (r2, best) in expected.items())


def test_runs_are_judged_by_the_noise_of_the_seeds(spark):
    rows = [("seed1_site", None, 0.5), ("seed2_site", None, 0.6), ("seed1_global", None, 0.4), ("seed2_global", None, 0.7),
            ("seed1_site", "a", 0.3), ("seed1_global", "a", 0.1), ("seed2_site", "a", 0.2), ("seed2_global", "a", 0.1),
            ("seed1_site", "b", 0.3), ("seed1_global", "b", 0.4), ("seed2_site", "b", 0.5), ("seed2_global", "b", 0.1)]
    floor = experiments.noise_floor(spark.createDataFrame(rows, "experiment string, site string, r2 double"))
    got = {r["site"]: r for r in floor.collect()}
    assert np.allclose([got["pooled"][c] for c in ("on_mean", "on_std", "off_mean", "off_std", "delta_mean")], [0.55, 0.05, 0.55, 0.15, 0.0])
    assert got["a"]["all_positive"] and not got["a"]["all_negative"] and not got["b"]["all_positive"]
    runs = [("baseline", None, 0.5), ("up", None, 0.7), ("near", None, 0.45), ("down", None, 0.1), ("baseline", "a", 0.2), ("up", "a", 0.2)]
    judged = experiments.significance(spark.createDataFrame([(*r, 1.0) for r in runs], "experiment string, site string, r2 double, mae double"), got["pooled"]["on_std"])
    verdicts = {(r["experiment"], r["site"]): (r["verdict"], r["significant"]) for r in judged.collect()}
    assert verdicts == {("up", "pooled"): ("keep", True), ("near", "pooled"): ("blend?", False), ("down", "pooled"): ("unstable", True), ("up", "a"): ("blend?", False)}
    assert {tuple(r) for r in experiments.recommendations(judged, floor).collect()} == {("sensitive", "up"), ("sensitive", "down"), ("unstable", "b")}


def test_perturbations_change_what_they_name(spark, raw):
    base = EngineConfig()
    found = backtest.perturbations(base)
    assert len(found) == 14 and found["swap_boosted_to_forest"].site("newport").forest_weight == 1.0 and found["swap_forest_to_boosted"].site("copalis").boosted_weight == 1.0
    assert found["minimal_features"].site("copalis").features == ("last_observed", "prev_obs_1", "month", "sst") and found["all_features"].site("copalis").features == ()
    assert found["forest_deep"].forest_at("copalis").trees == 600 and found["forest_deep"].forest_at("newport").trees == 200
    assert (found["relaxed_clip"].site("kalaloch").clip_quantile, found["relaxed_clip"].site("kalaloch").cap) == (0.99, None)
    assert found["halves_at_two_sites"].site("long beach").forest_weight == 0.5 and found["halves_at_two_sites"].site("newport") == base.site("newport")
    rows = backtest.training_frame(raw, None, SMALL).where("site = 'copalis'").toPandas()
    assert backtest.Training(rows, ["month"], "copalis", date(2016, 1, 4), date(2015, 12, 28), found["no_clip"]).cap == np.inf


def test_spikes_are_pooled_over_sites(spark):
    rng = np.random.default_rng(5)
    weeks = [date(2015, 1, 5) + timedelta(weeks=i) for i in range(80)]
    calm = [("calm", w, float(rng.uniform(0, 10))) for w in weeks]
    wild = [("wild", w, float(rng.uniform(21, 60) if i % 5 == 4 else rng.uniform(0, 10))) for i, w in enumerate(weeks)]
    frame = lambda rows: spark.createDataFrame(rows, "site string, date date, da_raw double")
    at = lambda rows: backtest.single_forecast(frame(rows), None, "calm", weeks[60], SMALL).first()
    alone, pooled = at(calm), at(calm + wild)
    assert alone["spike_probability"] is None and 0 < pooled["spike_probability"] < 1 and pooled["ensemble"] == alone["ensemble"]
    later = [(s, d, 99.0 if d >= weeks[60] else v) for s, d, v in calm + wild]
    assert at(later)["spike_probability"] == pooled["spike_probability"]
    # the pool: measured weeks only, the features of the week before, safe where the last value was no spike
    rows = backtest.training_frame(frame(calm + wild[:10] + wild[11:]), None, SMALL)
    pool = backtest.pooled_rows(rows, ["last_observed"]).where(F.col("week") < weeks[15]).collect()
    value = {(s, d): v for s, d, v in calm + wild if (s, d) != ("wild", weeks[10])}
    expected = []
    for (s, d), v in value.items():
        if d < weeks[15]:
            past = [u for (t, e), u in value.items() if t == s and e < d]
            expected.append((d, v >= 20, (past[-1] if past else 0) < 20, past[-1] if past else None))
    assert sorted(map(str, expected)) == sorted(str((r["week"], r["spike"], r["safe"], r["features"][0])) for r in pool)
    assert not set(backtest.SPIKE_LEAKS) - set(rows.columns)


def test_sums_by_cell_of_bins_of_one_byte(monkeypatch):
    monkeypatch.setattr(trees, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(7)
    x = rng.random((100, 4))
    x[:, 2] = np.nan
    binner = trees.Binner.fit(x)
    bins, cells, where, weight = binner(x), binner.cells(), rng.integers(0, 3, 100), rng.random(100)
    expected = np.zeros((3, len(cells.column)))
    for row, node, w in zip(bins, where, weight):
        expected[node, cells.start + row] += w
    assert bins.dtype == np.uint8 and np.allclose(trees._sums(where, bins, (weight,), 3, cells)[0], expected)


def test_spikes_of_a_single_forecast_are_fitted_by_all_tasks(spark):
    rng = np.random.default_rng(6)
    weeks = [date(2015, 1, 5) + timedelta(weeks=i) for i in range(90)]
    raw = spark.createDataFrame([(s, w, float(rng.gamma(0.7, 15))) for s in "abcd" for w in weeks], "site string, date date, da_raw double")
    rows = backtest.training_frame(raw, None, SMALL)
    asked = backtest._asked(spark, "a", weeks[70], SMALL)
    several = backtest.spike_probabilities_of_few(asked, rows.where("site = 'a'"), rows, SMALL)
    assert several._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and several.rdd.getNumPartitions() == 4
    one, few = backtest.spike_probabilities(asked, rows, SMALL).collect(), several.collect()
    assert len(few) == 1 and few[0][:2] == one[0][:2] == ("a", weeks[70]) and 0 < few[0][2] < 1
    # the same rows in parts give the trees of one task
    names = [n for n in backtest.feature_columns(rows, SMALL) if n not in backtest.SPIKE_LEAKS]
    pool = backtest.pooled_rows(rows, names).where(F.col("safe") & (F.col("week") <= weeks[69])).orderBy("week", "features").collect()
    x, y = np.array([r["features"] for r in pool], float), np.array([r["spike"] for r in pool], float)
    learner, weight = backtest._spike_learner(SMALL), np.where(y > 0, 2.0, 0.7)
    expected, parts, met, found = learner.fit(x, y, weight).predict(x[:9]), [None] * 3, threading.Barrier(3), [None] * 3

    def fit(rank: int) -> None:
        def gather(own: bytes) -> list[bytes]:
            parts[rank] = own
            met.wait()
            all_parts = list(parts)
            met.wait()
            return all_parts

        part = slice(*(len(y) * k // 3 for k in (rank, rank + 1)))
        found[rank] = boosted_shared(learner, x[part], y[part], weight[part], x[:9], Shared(gather, rank))

    threads = [threading.Thread(target=fit, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert np.ptp(expected) > 0 and np.abs(np.array(found) - expected).max() < 1e-9


def test_bootstrap_refits_the_blend(spark, raw):
    config = small(4, 3, bootstrap_rounds=7)
    rows = backtest.training_frame(raw, None, config)
    names = backtest.feature_columns(rows, config)
    for site, on in (("copalis", date(2016, 1, 4)), ("other", date(2016, 1, 11))):
        found = backtest.bootstrap_forecast(raw, None, site, on, config).first()
        p = backtest.Training(rows.where(F.col("site") == site).orderBy("week").toPandas(), names, site, on, on - timedelta(days=7), config)
        draws = [p.resampled(k) for k in range(7)]
        assert np.allclose([found["q05"], found["q50"], found["q95"]], np.percentile(draws, [5, 50, 95])) and np.std(draws) > 0


def test_registered_models_run_the_default_configuration(spark, sf, monkeypatch):
    from tidegrid.plans import registry

    seen = []
    monkeypatch.setattr(backtest, "single_forecast", lambda *args, **_: seen.append(args[-1]))
    monkeypatch.setattr(backtest, "retrospective", lambda *args: seen.append(args[2]) or spark.range(1))
    for name in ("model11_single_forecast", "model12_retrospective"):
        registry.queries()[name](spark, sf)
    assert seen == [EngineConfig(), EngineConfig()]
