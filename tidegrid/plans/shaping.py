"""Queries on columns, settings, samples and further service views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.config import SITES, EngineConfig
from tidegrid.functions import classes as C
from tidegrid.functions.scalars import site_key
from tidegrid.operators import aggregates as A
from tidegrid.operators import columns as K
from tidegrid.operators import experiments as E
from tidegrid.operators import metrics as M
from tidegrid.operators.windows import observation_lags
from tidegrid.plans import backtest
from tidegrid.plans.analysis import _ROWS, _TRANSIT
from tidegrid.plans.relational import _PER, _maps
from tidegrid.plans.base import KEY, PN, RESULTS, SERIES, WEEKLY, Catalogue, cell_counts, iso, q6, r6, raw, results, series, weekly
from tidegrid.operators.series import on_lattice, weekly_max
from tidegrid.runtime import table

CATALOGUE = Catalogue()
query = CATALOGUE.add


@query(f"WITH {SERIES}, l AS (SELECT *, lag(da_raw, 1 IGNORE NULLS) OVER (PARTITION BY site ORDER BY week) AS p FROM series) SELECT site, week::VARCHAR AS week FROM l WHERE coalesce(p, 0) < 20")
def proj11_safe_baseline(spark: SparkSession, d: str) -> DataFrame:
    rows = observation_lags(series(spark, d), lags=(1,), ages=())
    return rows.where(F.coalesce("prev_obs_1", F.lit(0.0)) < 20).select("site", iso("week").alias("week"))


@query(f"WITH {_TRANSIT} SELECT response_id, is_transition, actual >= 20 AS is_actual_spike, actual < 20 AS is_non_spike FROM moved")
def proj14_event_flags(spark: SparkSession, d: str) -> DataFrame:
    return E.transitions(results(spark, d), raw(spark, d)).select("response_id", "is_transition", "is_actual_spike", "is_non_spike")


@query("SELECT response_id, xgb_prediction AS boosted, rf_prediction AS forest FROM forecast_responses")
def proj16_named_rename(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "forecast_responses").select("response_id", "xgb_prediction", "rf_prediction")
    return K.rename(rows, {"xgb_prediction": "boosted", "rf_prediction": "forest"})


_KEPT = ("last_observed", "prev_obs_1", "roll_mean_4", "month")
_SUBSETS = {name: own.features for name, own in SITES.items() if own.features}
_LISTED = ", ".join(f"('{n}', '{f}')" for n, features in _SUBSETS.items() for f in features)


@query(f"""WITH {SERIES}, {_ROWS}, wide AS (SELECT s.site, s.week, k.last_observed, k.prev_obs_1, k.roll_mean_4, month(s.week)::DOUBLE AS month FROM series s JOIN known k ON k.site = s.site AND k.anchor = s.week - 7),
long AS ({' UNION ALL '.join(f"SELECT site, week, '{c}' AS feature, {c} AS value FROM wide" for c in _KEPT)}), own(site, feature) AS (VALUES {_LISTED})
SELECT site, week::VARCHAR AS week, feature, {q6('value')} AS value FROM long l WHERE site NOT IN (SELECT site FROM own) OR EXISTS (SELECT 1 FROM own o WHERE o.site = l.site AND o.feature = l.feature)""")
def proj19_site_features(spark: SparkSession, d: str) -> DataFrame:
    """Each week's features, cut to those that its site is configured to use."""
    rows = backtest.training_frame(raw(spark, d), cell_counts(spark, d))
    entries = F.create_map(*[x for c in _KEPT for x in (F.lit(c), F.col(c).cast("double"))])
    kept = K.keep_site_features(rows.select("site", "week", entries.alias("features")), "features", _SUBSETS)
    return kept.select("site", iso("week").alias("week"), F.explode("features").alias("feature", "value")).select("site", "week", "feature", r6("value"))


@query("SELECT coalesce(prediction, 0.0) AS prediction, 0.0::DOUBLE AS absent, coalesce(rf_prediction, 0.0) AS rf_prediction FROM forecast_responses")
def proj20_aligned_columns(spark: SparkSession, d: str) -> DataFrame:
    return K.align(table(spark, d, "forecast_responses"), ["prediction", "absent", "rf_prediction"])


@query("SELECT sample_id, CASE WHEN isfinite(v) THEN v END AS domoic_result FROM (SELECT sample_id, TRY_CAST(domoic_result AS DOUBLE) AS v FROM da_samples)")
def proj24_numeric_coercion(spark: SparkSession, d: str) -> DataFrame:
    return K.coerce_numbers(table(spark, d, "da_samples").select("sample_id", "domoic_result"), ["sample_id"])


_OWN = ", ".join(f"('{n}', {s.boosted_weight}::DOUBLE, {s.forest_weight}::DOUBLE, {s.clip_quantile or 'NULL'}::DOUBLE, {s.cap or 'NULL'}::DOUBLE)" for n, s in SITES.items())


@query(f"""WITH {WEEKLY}, own(site, b, f, q, cap) AS (VALUES {_OWN}) SELECT DISTINCT site, coalesce(b, 0.56) AS boosted_weight, coalesce(f, 0.44) AS forest_weight, q AS clip_quantile, cap FROM weekly LEFT JOIN own USING (site)""")
def join17_site_settings(spark: SparkSession, d: str) -> DataFrame:
    return K.site_settings(weekly(spark, d).select("site").distinct()).select("site", "boosted_weight", "forest_weight", "clip_quantile", "cap")


@query(f"""WITH {SERIES}, {PN}, wpn AS (SELECT site, CAST(date_trunc('week', date) AS DATE) AS week, max(pn) AS pn FROM pn GROUP BY 1, 2), j AS (SELECT site, week, da_raw, pn FROM series LEFT JOIN wpn USING (site, week))
SELECT site, week::VARCHAR AS week, last_value(da_raw IGNORE NULLS) OVER w AS da_raw, last_value(pn IGNORE NULLS) OVER w AS pn FROM j WINDOW w AS (PARTITION BY site ORDER BY week ROWS UNBOUNDED PRECEDING)""")
def join18_latest_by_variable(spark: SparkSession, d: str) -> DataFrame:
    both = on_lattice(weekly(spark, d)).join(weekly_max(cell_counts(spark, d), "pn"), ["site", "week"], "left")
    return K.latest_by_variable(both, "week", ["da_raw", "pn"]).select("site", iso("week").alias("week"), "da_raw", "pn")


@query(f"WITH {WEEKLY} SELECT site, CAST(count(DISTINCT CASE WHEN da_raw <= 5 THEN 0 WHEN da_raw <= 20 THEN 1 WHEN da_raw <= 40 THEN 2 ELSE 3 END) AS BIGINT) AS classes FROM weekly GROUP BY site")
def agg20_distinct_classes(spark: SparkSession, d: str) -> DataFrame:
    return weekly(spark, d).groupBy("site").agg(F.count_distinct(C.category_right_closed(F.col("da_raw"))).alias("classes"))


@query(f"WITH {_PER} SELECT site, feature, g, row_number() OVER (PARTITION BY site ORDER BY g DESC, feature) - 1 AS place FROM per")
def fn28_sorted_map(spark: SparkSession, d: str) -> DataFrame:
    rows = _maps(spark, d).select("site", F.posexplode(K.sorted_entries("feature_importance")).alias("place", "e"))
    return rows.select("site", F.col("e.key").alias("feature"), F.col("e.value").alias("g"), F.col("place").cast("long").alias("place"))


@query("WITH m AS (SELECT median(naive_prediction) AS m FROM forecast_responses) SELECT response_id, coalesce(naive_prediction, m) AS filled FROM forecast_responses, m")
def fn30_median_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "forecast_responses")
    middle = A.exact_quantile(rows, "naive_prediction")
    return rows.select("response_id", F.coalesce("naive_prediction", F.lit(middle)).alias("filled"))


@query("SELECT version_id, abs(lat - 46.5) <= 1e-8 + 1e-5 * 46.5 AS close FROM site_profiles WHERE lat IS NOT NULL")
def fn31_close_latitudes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "site_profiles").where("lat IS NOT NULL").select("version_id", K.close_to(F.col("lat"), F.lit(46.5)).alias("close"))


@query(f"""WITH {WEEKLY}, a AS (SELECT site, week, row_number() OVER (PARTITION BY site ORDER BY md5(site || '|' || week::VARCHAR || '|calibration42'), week) AS nth, count(*) OVER (PARTITION BY site) AS n FROM weekly)
SELECT site, week::VARCHAR AS test_date FROM a WHERE nth <= least(greatest(1, ceil(n * CAST(0.3 AS DOUBLE))), 20)""")
def win11_calibration_sample(spark: SparkSession, d: str) -> DataFrame:
    drawn = backtest.calibration_anchors(weekly(spark, d).withColumnRenamed("week", "test_date"))
    return drawn.select("site", iso("test_date").alias("test_date"))


_CAT = "CASE WHEN {0} < 5 THEN 0 WHEN {0} < 20 THEN 1 WHEN {0} < 40 THEN 2 ELSE 3 END"


@query(f"WITH {RESULTS} SELECT task, {q6('avg((' + _CAT.format('actual') + ' = ' + _CAT.format('naive_prediction') + ')::INT)')} AS accuracy FROM results WHERE naive_prediction IS NOT NULL GROUP BY task")
def eval04_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).where("naive_prediction IS NOT NULL")
    same = C.category_left_closed(F.col("actual")) == C.category_left_closed(F.col("naive_prediction"))
    return rows.groupBy("task").agg(r6(F.avg(same.cast("int")), "accuracy"))


@query(f"""WITH {RESULTS} SELECT strategy, count(*) AS n, {q6('avg(abs(actual - p))')} AS mae FROM (
  SELECT 'per_site' AS strategy, actual, prediction AS p FROM results UNION ALL SELECT 'boosted', actual, xgb_prediction FROM results UNION ALL SELECT 'naive', actual, naive_prediction FROM results
) WHERE p IS NOT NULL GROUP BY strategy""")
def eval16_strategies(spark: SparkSession, d: str) -> DataFrame:
    rows = M.long_predictions(results(spark, d), ["actual"], {"per_site": "prediction", "boosted": "xgb_prediction", "naive": "naive_prediction"})
    return M.regression_metrics(rows, ["model"]).select(F.col("model").alias("strategy"), "n", r6("mae"))


@query(f"WITH {RESULTS} SELECT site, date::VARCHAR AS date, response_id, actual, prediction FROM results WHERE site = 'copalis' AND prediction IS NOT NULL")
def eval18_site_view(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).where("site = 'copalis' AND prediction IS NOT NULL").orderBy("date", "response_id")
    return rows.select("site", iso("date").alias("date"), "response_id", "actual", "prediction")


@query("""SELECT CAST(s AS INTEGER) AS seed, per_site FROM (SELECT unnest([42, 123, 7, 2024, 99]) AS s), (SELECT unnest([true, false]) AS per_site)""")
def exp02_seed_grid(spark: SparkSession, d: str) -> DataFrame:
    runs = backtest.seeded(EngineConfig(), (42, 123, 7, 2024, 99))
    return spark.createDataFrame([(c.seed, c.per_site) for c in runs.values()], "seed int, per_site boolean")


@query(f"""WITH {WEEKLY}, m AS (SELECT min(least(da_raw, 80)) AS lo, max(least(da_raw, 80)) AS hi FROM (SELECT week, avg(da_raw) AS da_raw FROM weekly GROUP BY week))
SELECT week::VARCHAR AS week, {q6('(least(avg(da_raw), 80) - min(lo)) / (min(hi) - min(lo))')} AS scaled FROM weekly, m GROUP BY week""")
def api_comparison(spark: SparkSession, d: str) -> DataFrame:
    from tidegrid.operators.aggregates import min_max

    means = weekly(spark, d).groupBy("week").agg(F.avg("da_raw").alias("da_raw")).withColumn("all", F.lit(1))
    return min_max(means, "da_raw", "all", cap=80.0).select(iso("week").alias("week"), r6("scaled"))


@query(f"SELECT {KEY} AS site, count(*) AS requests, count(DISTINCT req_date) AS days FROM forecast_requests WHERE site IS NOT NULL GROUP BY 1")
def api_request_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "forecast_requests").where("site IS NOT NULL").groupBy(site_key(F.col("site")).alias("site"))
    return rows.agg(F.count("*").alias("requests"), F.count_distinct("req_date").alias("days"))
