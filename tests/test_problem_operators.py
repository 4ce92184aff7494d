"""The core's problem operators against plain loops, with nulls, ties, repeats and empty tables."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegrid.functions.scalars import reading_value, site_key, usable_reading
from tidegrid.operators.grid import weekly_grid
from tidegrid.operators.known_attributes import join_known, validity_intervals
from tidegrid.operators.rolling import trailing_totals

READINGS = "site string, t timestamp, x double, day string, total string"


def some_readings(spark, n=300, seed=1, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        site = "hot" if rng.random() < hot else rng.choice(["a", "b", None])
        t = datetime(2020, 1, 1) + timedelta(minutes=rng.randrange(0, 60 * 24 * 120)) if rng.random() > 0.05 else None
        rows.append((site, t, round(rng.random() * 30, 2) if rng.random() > 0.1 else None, "clash", None))
    rows += rows[:40]
    return rows, spark.createDataFrame(rows, READINGS)


def test_trailing_totals(spark):
    rows, df = some_readings(spark)
    seen = defaultdict(list)
    for site, t, x, *_ in set(rows):
        if None not in (site, t, x):
            seen[site].append((t.date(), x))
    expected = {}
    for site, values in seen.items():
        day, last = min(values)[0], max(values)[0]
        while day <= last:
            week = [x for d, x in values if day - timedelta(days=7) < d <= day]
            expected[site, day] = (len([1 for d, _ in values if d == day]), len(week), round(sum(week), 6))
            day += timedelta(days=1)
    got = {(r["entity"], r["day"]): (r["n"], r["n_7d"], round(r["total_7d"], 6)) for r in trailing_totals(df, "site", "t", "x", (7,)).collect()}
    assert got == expected
    empty = [r for r in trailing_totals(df, "site", "t", "x", (7,)).collect() if r["n_7d"] == 0]
    assert all(r["avg_7d"] is None and r["daily_avg_7d"] == 0 for r in empty)
    assert trailing_totals(df.limit(0), "site", "t", "x").count() == 0


def brute_grid(rows, kind, max_gap=None):
    series = defaultdict(dict)
    for site, t, x, *_ in rows:
        if None not in (site, t, x):
            series[site][t] = max(x, series[site].get(t, x))
    week = timedelta(days=7)
    out = {}
    for site, values in series.items():
        times = sorted(values)
        start = datetime.combine(times[0].date() - timedelta(days=times[0].weekday()), datetime.min.time())
        while start <= times[-1]:
            inc = cov = 0.0
            for a, b in zip(times, times[1:]):
                if max_gap and b - a > timedelta(days=max_gap):
                    continue
                share = max(timedelta(), min(b, start + week) - max(a, start)) / (b - a)
                if kind == "counter":
                    whole = values[b] - values[a] if values[b] >= values[a] else values[b]
                else:
                    whole = values[a] * ((b - a) / timedelta(days=1))
                inc += whole * share
                cov += share * ((b - a) / week)
            n = sum(start <= t < start + week for t in times)
            out[site, start.date()] = (n, round(inc, 5), round(cov, 5))
            start += week
    return out


@pytest.mark.parametrize("kind,gap", [("counter", None), ("level", None), ("level", 3)])
def test_weekly_grid(spark, kind, gap):
    rows, df = some_readings(spark, n=60, seed=7)
    found = weekly_grid(df, "site", "t", "x", kind=kind, max_gap_days=gap).collect()
    assert {(r["entity"], r["week_start"]): (r["readings"], round(r["increment"], 5), round(r["covered_share"], 5)) for r in found} == brute_grid(rows, kind, gap)
    assert all((r["status"] == "observed") == (r["readings"] > 0) for r in found)


def test_weekly_grid_edges(spark):
    one = spark.createDataFrame([("a", datetime(2020, 1, 6), 5.0)], "site string, t timestamp, x double")
    assert [(str(r["week_start"]), r["readings"], r["status"]) for r in weekly_grid(one, "site", "t", "x").collect()] == [("2020-01-06", 1, "observed")]
    assert weekly_grid(one.limit(0), "site", "t", "x").count() == 0
    resets = spark.createDataFrame([("a", datetime(2020, 1, 6 + d), float(v)) for d, v in ((0, 5), (1, 9), (2, 2), (3, 4))], "site string, t timestamp, x double")
    row = weekly_grid(resets, "site", "t", "x", kind="counter").first()
    assert (row["increment"], row["resets"]) == (8.0, 1)
    with pytest.raises(ValueError):
        weekly_grid(one, "site", "t", "x", kind="other")


def test_known_attributes(spark):
    rng = random.Random(3)
    base = date(2020, 1, 1)
    entries = []
    for i in range(120):
        start = base + timedelta(days=rng.randrange(200))
        known = datetime.combine(start, datetime.min.time()) + timedelta(hours=rng.choice([0, 0, 5, -40, 2000]))
        entries.append((i, rng.choice(["a", "b", None]), start, known if rng.random() > 0.1 else None, i * 10))
    entries += [(200 + i, *entries[i][1:]) for i in range(10)]
    events = [(i, rng.choice(["a", "b", "c", None]), base + timedelta(days=rng.randrange(-20, 400)) if rng.random() > 0.1 else None, "clash") for i in range(300)]
    events += events[:5]
    e = spark.createDataFrame(entries, "version long, site string, valid_from date, known_at timestamp, v long")
    v = spark.createDataFrame(events, "id long, site string, day date, version string")
    got = sorted((r["id"], r["known"]["version"], r["known"]["v"]) for r in join_known(v, "site", "day", validity_intervals(e, "site", "valid_from", "known_at", "version", ["v"]), bucket_days=10).collect())
    expected = []
    for i, site, day, _ in events:
        if site is None or day is None:
            continue
        fit = [x for x in entries if x[1] == site and x[3] is not None and x[2] <= day and x[3] <= datetime.combine(day, datetime.min.time())]
        if fit:
            best = max(fit, key=lambda x: (x[2], x[3], x[0]))
            expected.append((i, best[0], best[4]))
    assert got == sorted(expected)
    none = validity_intervals(e.limit(0), "site", "valid_from", "known_at", "version")
    assert join_known(v, "site", "day", none).count() == 0


def test_readings_and_sites(spark):
    texts = {"1": 1.0, " 2.5\t": 2.5, "<1": 0.5, "< 3\r": 1.5, ".5": None, "5.": None, "-1": None, "NaN": None, "inf": None, "1e3": None, "1,000": None, "": None, None: None, "٣": None}
    df = spark.createDataFrame([(k,) for k in texts], "s string")
    for row in df.select("s", reading_value(F.col("s")).alias("v"), usable_reading(F.col("s")).alias("u")).collect():
        assert row["v"] == texts[row["s"]] and row["u"] == (texts[row["s"]] is not None)
    names = spark.createDataFrame([(" Long-Beach\t",), ("long_beach",), ("LONG BEACH\r",)], "s string")
    assert names.select(site_key(F.col("s"))).distinct().count() == 1


def test_time_zone_of_the_session_makes_no_difference(spark, sf):
    from tidegrid.plans.problems import QUERIES

    names = ("p2_trailing", "p3_grid", "p4_found")
    run = lambda: [sorted(map(tuple, QUERIES[n](spark, sf).collect()), key=repr) for n in names]
    expected = run()
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert run() == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
