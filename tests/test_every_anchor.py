"""Queries over every observed week as an anchor, against brute force."""

from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest

from tidegrid.operators.joins import leakage_report
from tidegrid.plans import registry
from tidegrid.plans.base import weekly

QUERIES = registry.queries()


@pytest.fixture(scope="module")
def brute(spark, sf):
    """(site, test date) -> (weeks, values) of the site up to a week before, for every observed week."""
    sites = defaultdict(list)
    for r in weekly(spark, sf).collect():
        sites[r["site"]].append((r["week"], r["da_raw"]))
    histories = {}
    for site, rows in sites.items():
        for test, _ in rows:
            past = sorted((w, v) for w, v in rows if w <= test - timedelta(days=7))
            if len(past) >= 10:
                histories[site, str(test)] = past
    return histories


def rows_of(spark, sf, name):
    return {(r["site"], r["test_date"]): r for r in QUERIES[name](spark, sf).collect()}


def test_every_observed_week_is_an_anchor(spark, sf, brute):
    assert {test[5:7] for _, test in brute} == {f"{m:02}" for m in range(1, 13)}
    windows, checks, last, range_, naive = (rows_of(spark, sf, n) for n in (
        "join14_training_windows", "proj25_leakage_check", "win14_anchor_persistence", "model01_transformer", "model10_naive_clip"))
    for found in (windows, checks, last, range_, naive):
        assert found.keys() == brute.keys()
    close = lambda a, b: abs(a - b) < 2e-6
    for key, past in brute.items():
        values, test = [v for _, v in past], date.fromisoformat(key[1])
        q99, med = np.quantile(values, 0.99), np.median(values)
        assert windows[key]["n"] == len(past) and close(windows[key]["mean"], np.mean(values)) and close(windows[key]["q99"], q99) and close(windows[key]["med"], med)
        assert checks[key]["last_train"] == str(past[-1][0]) and checks[key]["clean"]
        spikes = [w for w, v in past if v > 20]
        assert last[key]["last_observed"] == values[-1] and close(last[key]["weeks_since_spike"], (test - spikes[-1]).days / 7 if spikes else 999)
        assert close(range_[key]["med"], med) and (range_[key]["lo"], range_[key]["hi"]) == (min(values), max(values))
        p = min(max(values[-1], 0), q99)
        assert close(naive[key]["naive"], p) and naive[key]["category"] == np.searchsorted([5.0, 20.0, 40.0], p)


def test_pooled_over_every_observed_week(spark, sf):
    rows = [(r["week"], r["da_raw"]) for r in weekly(spark, sf).collect()]
    expected = {}
    for anchor in {w - timedelta(days=7) for w, _ in rows}:
        past = [v for w, v in rows if w <= anchor]
        if past:
            expected[str(anchor)] = (len(past), sum(v >= 20 for v in past))
    assert {r["anchor"]: (r["n"], r["spikes"]) for r in QUERIES["join15_pooled_range"](spark, sf).collect()} == expected


def test_a_leak_outside_june_is_reported(spark):
    leaky = [("a", date(2020, 11, 9), date(2020, 11, 2), date(2020, 10, 5)), ("a", date(2020, 11, 9), date(2020, 11, 2), date(2020, 11, 9))]
    rows = leakage_report(spark.createDataFrame(leaky, "site string, test_date date, anchor date, week date"), keys=["site", "test_date"], min_rows=2).collect()
    assert [r["clean"] for r in rows] == [False]
