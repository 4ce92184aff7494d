"""Windows, evaluation, spectra, models, experiments, service queries and streams."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.config import EngineConfig, MODELS
from tidegrid.functions import classes as C
from tidegrid.functions.scalars import settled, site_key
from tidegrid.operators import aggregates as A
from tidegrid.operators import experiments as E
from tidegrid.operators import metrics as M
from tidegrid.operators import spectral as S
from tidegrid.operators.series import FIRST_WEEK, LAST_WEEK, on_lattice, weekly_max
from tidegrid.operators.windows import decay_fill, forward_fill, observation_lags, persistence, rolling_past
from tidegrid.plans import backtest
from tidegrid.plans.base import KEY, PN, RAW, RESULTS, SERIES, WEEKLY, Catalogue, cell_counts, iso, q6, r6, raw, results, series, weekly
from tidegrid.plans.relational import _ANCHORS, _at_every_week
from tidegrid.runtime import discard_at_end, materialise, table
from tidegrid.sources.files import scratch
from tidegrid.streaming.pipelines import alert_stream, delayed_month_stream, persistence_stream, run_once, run_updates, weekly_max_stream

CATALOGUE = Catalogue()
query = CATALOGUE.add


# -- windows -------------------------------------------------------------------------------------

_SO_FAR = "PARTITION BY site ORDER BY week ROWS UNBOUNDED PRECEDING"
_PERSIST = f"""persist AS (
  SELECT *, last_value(da_raw IGNORE NULLS) OVER ({_SO_FAR}) AS last_observed,
         coalesce((week - max(CASE WHEN da_raw > 20 THEN week END) OVER ({_SO_FAR})) / 7.0, 999.0) AS weeks_since_spike
  FROM series
)"""


@query(f"WITH {SERIES}, {_PERSIST} SELECT site, week::VARCHAR AS week, last_observed, {q6('weeks_since_spike')} AS weeks_since_spike FROM persist")
def win01_persistence(spark: SparkSession, d: str) -> DataFrame:
    return persistence(series(spark, d)).select("site", iso("week").alias("week"), "last_observed", r6("weeks_since_spike"))


_ROLL = ", ".join([q6("avg(last_observed) OVER (PARTITION BY site ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)") + " AS roll_mean_4"] + [
    f"{q6(f'{f}(last_observed) OVER (PARTITION BY site ORDER BY week ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)')} AS roll_{name}_{n}"
    for n in (4, 8, 12) for f, name in (("stddev_samp", "std"), ("max", "max"))
])


@query(f"WITH {SERIES}, {_PERSIST} SELECT site, week::VARCHAR AS week, {_ROLL} FROM persist")
def win04_rolling(spark: SparkSession, d: str) -> DataFrame:
    rows = rolling_past(persistence(series(spark, d)))
    return rows.select("site", iso("week").alias("week"), *[r6(c) for c in rows.columns if c.startswith("roll_")])


_LAGS = ", ".join(f"lag(da_raw, {k} IGNORE NULLS) OVER w AS prev_obs_{k}" for k in (1, 2, 3, 4))
_AGES = ", ".join(f"round((week - lag(CASE WHEN da_raw IS NOT NULL THEN week END, {k} IGNORE NULLS) OVER w) / 7.0 + 1e-9, 6) AS prev_obs_{k}_weeks" for k in (2, 3))


@query(f"WITH {SERIES}, l AS (SELECT *, {_LAGS}, {_AGES} FROM series WINDOW w AS (PARTITION BY site ORDER BY week)) SELECT site, week::VARCHAR AS week, prev_obs_1, prev_obs_2, prev_obs_3, prev_obs_4, prev_obs_2_weeks, prev_obs_3_weeks, {q6('prev_obs_1 - prev_obs_2')} AS prev_obs_diff FROM l")
def win05_observation_lags(spark: SparkSession, d: str) -> DataFrame:
    rows = observation_lags(series(spark, d))
    return rows.select("site", iso("week").alias("week"), *[f"prev_obs_{k}" for k in (1, 2, 3, 4)], r6("prev_obs_2_weeks"), r6("prev_obs_3_weeks"), r6("prev_obs_diff"))


_DECAY = f"""decay AS (
  SELECT *, last_value(da_raw IGNORE NULLS) OVER ({_SO_FAR}) AS v, (week - max(CASE WHEN da_raw IS NOT NULL THEN week END) OVER ({_SO_FAR})) / 7.0 AS gap FROM series
)"""


@query(f"WITH {SERIES}, {_DECAY} SELECT site, week::VARCHAR AS week, {q6('coalesce(da_raw, v * exp(-0.2 * gap), 0)')} AS da, {q6('coalesce(da_raw, CASE WHEN gap <= 2 THEN v * exp(-0.2 * gap) END, 0)')} AS da_limited FROM decay")
def win08_decay_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = decay_fill(decay_fill(series(spark, d), "da_raw", 0.2, name="da"), "da_raw", 0.2, max_gap=2, name="da_limited")
    return rows.select("site", iso("week").alias("week"), r6("da"), r6("da_limited"))


@query(f"WITH {SERIES}, m AS (SELECT median(da_raw) AS m FROM series) SELECT site, week::VARCHAR AS week, coalesce(last_value(da_raw IGNORE NULLS) OVER ({_SO_FAR}), (SELECT m FROM m)) AS filled FROM series")
def win09_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = materialise(weekly(spark, d), "weekly")
    middle = A.exact_quantile(rows.where(F.col("week").between(FIRST_WEEK, LAST_WEEK)), "da_raw")
    return forward_fill(on_lattice(rows), "da_raw").select("site", iso("week").alias("week"), F.coalesce("da_raw", F.lit(middle)).alias("filled"))


@query(f"""WITH {WEEKLY}, l AS (SELECT site, da_raw AS x, lag(da_raw) OVER (PARTITION BY site ORDER BY week) AS y FROM weekly)
SELECT site, count(*) AS n, {q6('CASE WHEN count(*) >= 4 THEN corr(x, y) END')} AS rho, {q6('CASE WHEN count(*) >= 4 THEN corr(x, y) ** 2 END')} AS rho2, {q6('avg(x)')} AS mean, {q6('stddev_pop(x)')} AS std, {q6('avg((x > 0)::INT) * 100')} AS pct_positive FROM l GROUP BY site""")
def win12_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    found = E.autocorrelation(weekly(spark, d), "da_raw", "week")
    return found.select("site", "n", *[r6(c) for c in ("rho", "rho2", "mean", "std", "pct_positive")])


@query(f"WITH {RAW} SELECT sample_id, lag(da_raw) OVER w AS previous, date_diff('day', lag(date) OVER w, date) AS gap_days FROM raw WINDOW w AS (PARTITION BY site ORDER BY t, sample_id)")
def win13_previous_observation(spark: SparkSession, d: str) -> DataFrame:
    return E.previous_observation(raw(spark, d), ["t", "sample_id"], "da_raw", "date").select("sample_id", "previous", F.col("gap_days").cast("long").alias("gap_days"))


@query(f"""WITH {WEEKLY}, {_ANCHORS} SELECT site, test_date::VARCHAR AS test_date, arg_max(da_raw, week) AS last_observed,
{q6('coalesce((max(test_date) - max(CASE WHEN da_raw > 20 THEN week END)) / 7.0, 999.0)')} AS weeks_since_spike FROM sized WHERE n >= 10 GROUP BY 1, 2""")
def win14_anchor_persistence(spark: SparkSession, d: str) -> DataFrame:
    return _at_every_week(spark, d).select("site", iso("test_date").alias("test_date"), "last_observed", r6("weeks_since_spike"))


# -- evaluation ----------------------------------------------------------------------------------

_MODELS = {"boosted": "xgb_prediction", "forest": "rf_prediction", "naive": "naive_prediction", "blend": "prediction"}
_LONG = RESULTS + ", long AS (" + " UNION ALL ".join(f"SELECT response_id, site, date, actual, '{m}' AS model, {c} AS predicted FROM results" for m, c in _MODELS.items()) + ")"


def _long(spark: SparkSession, d: str) -> DataFrame:
    return M.long_predictions(results(spark, d), ["response_id", "site", "date", "actual"], _MODELS)


_REG = f"count(*) AS n, {q6('CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) END')} AS r2, {q6('avg(abs(actual - predicted))')} AS mae, {q6('sqrt(avg((actual - predicted) ** 2))')} AS rmse"


@query(f"WITH {_LONG} SELECT model, {_REG} FROM long WHERE predicted IS NOT NULL GROUP BY model")
def eval01_regression(spark: SparkSession, d: str) -> DataFrame:
    found = M.regression_metrics(_long(spark, d), ["model"])
    return found.select("model", "n", r6("r2"), r6("mae"), r6("rmse"))


@query(f"WITH {_LONG} SELECT model, site, {_REG.replace('var_pop(actual) > 0', 'var_pop(actual) * count(*) > 1e-12')} FROM long WHERE predicted IS NOT NULL GROUP BY GROUPING SETS ((model), (model, site))")
def eval01_by_site(spark: SparkSession, d: str) -> DataFrame:
    found = M.regression_metrics(_long(spark, d).where("predicted IS NOT NULL"), ["model"], ["site"])
    return found.select("model", "site", "n", r6("r2"), r6("mae"), r6("rmse"))


@query()
def eval02_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of each model from 2,000 resamples, of differences to the first from 10,000."""
    rows, models = results(spark, d), ["prediction", "xgb_prediction", "rf_prediction", "naive_prediction"]
    own = M.bootstrap_intervals(rows, key="response_id", actual="actual", models=models, replicates=2000).where("metric <> 'delta_r2'")
    return own.unionByName(M.bootstrap_intervals(rows, key="response_id", actual="actual", models=models, replicates=10_000).where("metric = 'delta_r2'"))


_CAT = "CASE WHEN {0} < 5 THEN 0 WHEN {0} < 20 THEN 1 WHEN {0} < 40 THEN 2 WHEN {0} >= 40 THEN 3 END"
_CATS = RESULTS + f", cats AS (SELECT {_CAT.format('actual')} AS a, {_CAT.format('naive_prediction')} AS p FROM results WHERE naive_prediction IS NOT NULL)"


def _categories(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select(C.category_left_closed(F.col("actual")).alias("a"), C.category_left_closed(F.col("naive_prediction")).alias("p"))


_REPORT = """report AS (
  SELECT category, support, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM (
    SELECT CAST(c AS INTEGER) AS category, count(*) FILTER (WHERE a = c) AS support, count(*) FILTER (WHERE p = c) AS called, count(*) FILTER (WHERE a = c AND p = c) AS tp
    FROM cats, range(4) AS r(c) GROUP BY c
  )
), scored AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM report)"""


@query(f"WITH {_CATS}, {_REPORT} SELECT category, support, {q6('precision')} AS precision, {q6('recall')} AS recall, {q6('f1')} AS f1 FROM scored")
def eval05_class_report(spark: SparkSession, d: str) -> DataFrame:
    return M.class_report(_categories(spark, d), "a", "p").select("category", "support", r6("precision"), r6("recall"), r6("f1"))


@query(f"WITH {_CATS}, {_REPORT} SELECT CAST(sum(support) AS BIGINT) AS n, {q6('sum(recall * support) / sum(support)')} AS accuracy, {q6('avg(recall)')} AS balanced_accuracy, {q6('avg(f1)')} AS macro_f1 FROM scored WHERE support > 0")
def eval11_class_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.class_summary(_categories(spark, d), "a", "p").select("n", r6("accuracy"), r6("balanced_accuracy"), r6("macro_f1"))


def _event_sql(event: str, alarm: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {e} AND {a}) AS {n}" for n, e, a in (
        ("tp", event, alarm), ("fp", f"NOT ({event})", alarm), ("fn", event, f"NOT ({alarm})"), ("tn", f"NOT ({event})", f"NOT ({alarm})")))
    return counts


def _rates(source: str, keys: str = "") -> str:
    rate = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END"
    return f"""SELECT {keys} tp, fp, fn, tn, {q6('recall')} AS recall, {q6('precision')} AS precision,
  {q6(rate('2 * precision * recall', 'precision + recall'))} AS f1, {q6(rate('5 * precision * recall', '4 * precision + recall'))} AS f2,
  {q6(rate('fn', 'tp + fn'))} AS fnr, {q6(rate('fp', 'fp + tn'))} AS fpr
FROM (SELECT *, {rate('tp', 'tp + fp')} AS precision, {rate('tp', 'tp + fn')} AS recall FROM {source})"""


_RATES = ("recall", "precision", "f1", "f2", "fnr", "fpr")
_ALERT = "(coalesce(spike_probability >= 0.10, false) OR coalesce(prediction >= 12, false))"


_ARMS = {"hybrid": (_ALERT, "spike_probability IS NOT NULL OR prediction IS NOT NULL"), "regression": ("prediction >= 12", "prediction IS NOT NULL")}
_ZONES = {"event": "actual >= 20", "transition": "actual >= 12 AND actual < 20"}
_TABLES = " UNION ALL ".join(
    f"SELECT task, '{z}' AS zone, '{arm}' AS arm, {_event_sql(event, alarm)} FROM results WHERE {known} GROUP BY task"
    for z, event in _ZONES.items() for arm, (alarm, known) in _ARMS.items())


@query(f"WITH {RESULTS}, c AS ({_TABLES}) {_rates('c', 'task, zone, arm,')}")
def eval06_hybrid_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Events and the transition zone below them, by the hybrid alert and by the regression alone, in one pass."""
    rows, p, a = results(spark, d), F.col("prediction"), F.col("actual")
    alarms = {"hybrid": C.hybrid_alert(F.col("spike_probability"), p), "regression": p >= C.ALERT_PREDICTION}
    events = {"event": C.is_spike(a), "transition": (a >= C.ALERT_PREDICTION) & (a < C.SPIKE)}
    cases = F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(n).alias("arm"), e.alias("event"), x.alias("alarm")) for z, e in events.items() for n, x in alarms.items()])
    long = rows.select("task", F.explode(cases).alias("c")).select("task", "c.*").where("alarm IS NOT NULL")
    return long.groupBy("task", "zone", "arm").agg(*M.event_columns(F.col("event"), F.col("alarm"))).select("task", "zone", "arm", "tp", "fp", "fn", "tn", *[r6(c) for c in _RATES])


_ERRORS = "avg(abs(actual - predicted)) FILTER (WHERE actual >= 20) AS on_spikes, avg(abs(actual - predicted)) FILTER (WHERE actual < 20) AS off_spikes"


@query(f"""WITH {_LONG}, c AS (SELECT model, {_event_sql('actual >= 20', 'predicted >= 20')}, {_ERRORS} FROM long WHERE predicted IS NOT NULL GROUP BY model)
{_rates('c', f"model, {q6('on_spikes')} AS mae_on_spikes, {q6('off_spikes')} AS mae_off_spikes,")}""")
def eval07_spike_metrics(spark: SparkSession, d: str) -> DataFrame:
    spike, error = C.is_spike(F.col("actual")), F.abs(F.col("actual") - F.col("predicted"))
    found = _long(spark, d).where("predicted IS NOT NULL").groupBy("model").agg(
        *M.event_columns(spike, C.is_spike(F.col("predicted"))), F.avg(F.when(spike, error)).alias("mae_on_spikes"), F.avg(F.when(~spike, error)).alias("mae_off_spikes"))
    return found.select("model", "tp", "fp", "fn", "tn", *[r6(c) for c in (*_RATES, "mae_on_spikes", "mae_off_spikes")])


_TRANSIT = f"""{RESULTS}, ups AS (SELECT site, date AS d0, max(da_raw) AS v FROM raw GROUP BY 1, 2),
moved AS (SELECT r.*, coalesce(u.v < 20 AND r.actual >= 20, false) AS is_transition FROM results r ASOF LEFT JOIN ups u ON r.site = u.site AND u.d0 < r.date)"""


@query(f"""WITH {_TRANSIT} SELECT count(*) AS transitions, {q6('avg((naive_prediction >= 20)::INT)')} AS recall, {q6('avg(naive_prediction)')} AS mean_predicted, {q6('avg(actual)')} AS mean_actual, {q6('avg(abs(actual - naive_prediction))')} AS mae
FROM moved WHERE is_transition AND naive_prediction IS NOT NULL""")
def eval08_transitions(spark: SparkSession, d: str) -> DataFrame:
    found = E.transitions(results(spark, d), raw(spark, d)).where("is_transition AND naive_prediction IS NOT NULL")
    return found.agg(
        F.count("*").alias("transitions"), r6(F.avg((F.col("naive_prediction") >= 20).cast("int")), "recall"), r6(F.avg("naive_prediction"), "mean_predicted"),
        r6(F.avg("actual"), "mean_actual"), r6(F.avg(F.abs(F.col("actual") - F.col("naive_prediction"))), "mae"),
    )


_THRESHOLDS = (8, 10, 12, 14, 15, 16, 18, 20, 22, 25, 30)


@query(f"WITH {RESULTS}, c AS (SELECT threshold, {_event_sql('actual >= 20', 'naive_prediction >= threshold')} FROM results, (SELECT unnest([{', '.join(f'{t}.0::DOUBLE' for t in _THRESHOLDS)}]) AS threshold) WHERE naive_prediction IS NOT NULL GROUP BY 1) {_rates('c', 'threshold,')}")
def eval09_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    found = M.threshold_sweep(results(spark, d), C.is_spike(F.col("actual")), "naive_prediction", _THRESHOLDS)
    return found.select("threshold", "tp", "fp", "fn", "tn", *[r6(c) for c in _RATES])


@query(f"WITH {RESULTS}, c AS (SELECT site, count(*) AS n, {_event_sql('actual >= 20', 'spike_probability >= 0.10')} FROM results WHERE spike_probability IS NOT NULL GROUP BY GROUPING SETS ((), (site)) HAVING count(*) >= 3) {_rates('c', 'site, n,')}")
def eval10_classifier(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).where("spike_probability IS NOT NULL")
    found = rows.groupingSets([[], ["site"]], "site").agg(F.count("*").alias("n"), *M.event_columns(C.is_spike(F.col("actual")), F.col("spike_probability") >= C.ALERT_PROBABILITY))
    return found.where("n >= 3").select("site", "n", "tp", "fp", "fn", "tn", *[r6(c) for c in _RATES])


@query(f"WITH {_LONG} SELECT site, model, predicted, actual FROM long WHERE predicted IS NOT NULL")
def eval15_model_long(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).where("predicted IS NOT NULL").select("site", "model", "predicted", "actual")


# -- spectra, of the series with its gaps filled, by site and of the mean over all sites ----------

_WEEKS = (LAST_WEEK - FIRST_WEEK).days // 7 + 1


def _filled(spark: SparkSession, d: str) -> DataFrame:
    rows = decay_fill(series(spark, d), "da_raw", EngineConfig().da_decay, name="value").select("site", "week", "value")
    return S.with_all_sites(rows)


_FILLED = f"""{SERIES}, {_DECAY}, own AS (SELECT site, week, coalesce(da_raw, v * exp(-0.2 * gap), 0) AS da FROM decay),
filled AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY week) - 1 AS i, da FROM (SELECT site, week, da FROM own UNION ALL SELECT 'All Sites', week, avg(da) FROM own GROUP BY week))"""


def _fourier(size: int, step: int, window: str) -> str:
    """One-sided power densities by direct sums: (site, s, k, power) of the segments of ``size`` values, ``step`` apart."""
    segments = (_WEEKS - size) // step + 1
    doubled = (size + 1) // 2
    return f"""parts AS (
  SELECT site, s, i - s * {step} AS j, da - avg(da) OVER (PARTITION BY site, s) AS x FROM filled, range({segments}) AS r(s) WHERE i >= s * {step} AND i < s * {step} + {size}
), waves AS (SELECT k, j, cos(2 * pi() * ((k * j) % {size}) / {size}) * w AS c, sin(2 * pi() * ((k * j) % {size}) / {size}) * w AS n
  FROM range({size // 2 + 1}) AS a(k), (SELECT j, {window} AS w FROM range({size}) AS b(j))
), sums AS (SELECT site, s, k, sum(x * c) AS re, sum(x * n) AS im FROM parts JOIN waves USING (j) GROUP BY 1, 2, 3),
density AS (SELECT site, s, k, (re * re + im * im) / (SELECT sum(({window}) ** 2) FROM range({size}) AS b(j)) * CASE WHEN k > 0 AND k < {doubled} THEN 2 ELSE 1 END AS power FROM sums)"""


_SIZE = max(min(256, _WEEKS // 4), 4)
_WELCH = f"{_FILLED}, {_fourier(_SIZE, _SIZE - _SIZE // 2, f'0.5 - 0.5 * cos(2 * pi() * j / {_SIZE})')}, welch AS (SELECT site, k, avg(power) AS power FROM density WHERE k > 0 GROUP BY 1, 2)"
_SHORT = min(32, _WEEKS // 4)
_TUKEY = f"CASE WHEN least(j, {_SHORT} - j) / {_SHORT}.0 < 0.125 THEN 0.5 - 0.5 * cos(pi() * least(j, {_SHORT} - j) / {_SHORT}.0 / 0.125) ELSE 1.0 END"


def _q3(expression: str) -> str:
    return f"round(({expression}) + 1e-6, 3)"


def _r3(column: str) -> F.Column:
    return settled(F.col(column), 3).alias(column)


def _spectrum(found: DataFrame) -> DataFrame:
    return found.select("site", r6("frequency"), r6("period_weeks"), _r3("power"))


@query(f"WITH {_WELCH} SELECT site, {q6(f'k / {_SIZE}.0')} AS frequency, {q6(f'{_SIZE}.0 / k')} AS period_weeks, {_q3('power')} AS power FROM welch")
def spec01_welch(spark: SparkSession, d: str) -> DataFrame:
    return _spectrum(S.spectra(_filled(spark, d), "welch"))


@query(f"WITH {_WELCH}, top AS (SELECT site, k, row_number() OVER (PARTITION BY site ORDER BY power DESC, k) AS nth FROM welch) SELECT site, nth, {q6(f'{_SIZE}.0 / k')} AS period_weeks FROM top WHERE nth <= 3")
def spec02_dominant_periods(spark: SparkSession, d: str) -> DataFrame:
    found = S.dominant_periods(S.spectra(_filled(spark, d), "welch"))
    ranked = found.select("site", F.posexplode("periods").alias("nth", "period_weeks"))
    return ranked.select("site", (F.col("nth") + 1).cast("long").alias("nth"), r6("period_weeks"))


@query(f"WITH {_FILLED}, {_fourier(_WEEKS, _WEEKS, '1.0')} SELECT site, {q6(f'k / {_WEEKS}.0')} AS frequency, {q6(f'{_WEEKS}.0 / k')} AS period_weeks, {_q3('power')} AS power FROM density WHERE k > 0")
def spec03_periodogram(spark: SparkSession, d: str) -> DataFrame:
    return _spectrum(S.spectra(_filled(spark, d), "periodogram"))


@query(f"WITH {_FILLED}, {_fourier(_SHORT, _SHORT - _SHORT // 2, _TUKEY)} SELECT site, s::INTEGER AS segment, {q6(f'k / {_SHORT}.0')} AS frequency, {_q3('log10(greatest(power + 1e-10, 1e-6))')} AS log_power FROM density")
def spec04_spectrogram(spark: SparkSession, d: str) -> DataFrame:
    """Powers below 1e-6 are shown as that, as those of silent stretches are rounding."""
    found = S.spectrograms(_filled(spark, d)).withColumn("log_power", F.greatest("log_power", F.lit(-6.0)))
    return found.select("site", "segment", r6("frequency"), _r3("log_power"))


@query()
def spec05_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Actual values against the stored predictions of both models, by site, where there are twenty at least."""
    rows = results(spark, d)
    found = [
        S.coherences(rows, "actual", column, ("date", "response_id")).select("site", F.lit(model).alias("model"), "frequency", "coherence")
        for model, column in (("boosted", "xgb_prediction"), ("forest", "rf_prediction"))
    ]
    return found[0].unionByName(found[1])


@query(f"""WITH {_WELCH}, v AS (SELECT site, count(*) AS n, avg(da) AS mean, stddev_pop(da) AS std FROM filled GROUP BY 1)
SELECT site, n, {q6('mean')} AS mean, {q6('std')} AS std, {_q3('sum(power)')} AS total_power FROM v JOIN welch USING (site) GROUP BY site, n, mean, std""")
def spec06_summary(spark: SparkSession, d: str) -> DataFrame:
    values = _filled(spark, d)
    return S.spectral_summary(values, S.spectra(values, "welch")).select("site", "n", r6("mean"), r6("std"), _r3("total_power"))


# -- models --------------------------------------------------------------------------------------

@query(f"WITH {WEEKLY}, {_ANCHORS} SELECT site, test_date::VARCHAR AS test_date, {q6('median(da_raw)')} AS med, min(da_raw) AS lo, max(da_raw) AS hi FROM sized WHERE n >= 10 GROUP BY 1, 2")
def model01_transformer(spark: SparkSession, d: str) -> DataFrame:
    return _at_every_week(spark, d).select("site", iso("test_date").alias("test_date"), r6("med"), "lo", "hi")


@query(f"WITH {WEEKLY}, {_ANCHORS}, b AS (SELECT site, test_date, quantile_cont(da_raw, 0.99) AS q, arg_max(da_raw, week) AS v FROM sized WHERE n >= 10 GROUP BY 1, 2) SELECT site, test_date::VARCHAR AS test_date, {q6('least(greatest(v, 0), q)')} AS naive, CASE WHEN least(v, q) <= 5 THEN 0 WHEN least(v, q) <= 20 THEN 1 WHEN least(v, q) <= 40 THEN 2 ELSE 3 END AS category FROM b")
def model10_naive_clip(spark: SparkSession, d: str) -> DataFrame:
    p = C.clipped(F.col("last_observed"), F.col("q99"))
    return _at_every_week(spark, d).select("site", iso("test_date").alias("test_date"), r6(p, "naive"), C.category_right_closed(p).alias("category"))


_SITE, _DAY = "copalis", date(2023, 6, 12)


@query()
def model11_single_forecast(spark: SparkSession, d: str) -> DataFrame:
    return backtest.single_forecast(raw(spark, d), cell_counts(spark, d), _SITE, _DAY, EngineConfig(), task="regression")


@query()
def api_forecast_enhanced(spark: SparkSession, d: str) -> DataFrame:
    """Regression with its interval and classification with its probabilities, in one row."""
    found = backtest.single_forecast(raw(spark, d), cell_counts(spark, d), _SITE, _DAY, EngineConfig(), task="both")
    own = EngineConfig().site(_SITE)
    weights = F.array(*[F.lit(w) for w in (own.boosted_weight, own.forest_weight, own.naive_weight)])
    return found.select(
        "site", iso("test_date").alias("forecast_date"), "predicted", F.struct("q05", "q50", "q95").alias("level_range"), "predicted_category", "class_probabilities",
        F.struct("naive", "boosted", "forest", "ensemble", weights.alias("weights")).alias("parts"), "spike_probability", "spike_alert",
    )


@query()
def model12_retrospective(spark: SparkSession, d: str) -> DataFrame:
    return backtest.retrospective(raw(spark, d), cell_counts(spark, d), EngineConfig())


_ROWS = f"""{_PERSIST}, known AS (
  SELECT site, week AS anchor, last_observed, max(CASE WHEN da_raw > 20 THEN week END) OVER ({_SO_FAR}) AS spiked,
         lag(da_raw, 1 IGNORE NULLS) OVER w AS prev_obs_1, avg(last_observed) OVER (PARTITION BY site ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS roll_mean_4
  FROM persist WINDOW w AS (PARTITION BY site ORDER BY week)
)"""


@query(f"""WITH {SERIES}, {_ROWS} SELECT s.site, s.week::VARCHAR AS week, s.da_raw, k.last_observed, {q6("coalesce((s.week - k.spiked) / 7.0, 999.0)")} AS weeks_since_spike,
k.prev_obs_1, {q6("k.roll_mean_4")} AS roll_mean_4, month(s.week)::INTEGER AS month, {q6("sin(2 * pi() * dayofyear(s.week) / 365)")} AS sin_day_of_year
FROM series s JOIN known k ON k.site = s.site AND k.anchor = s.week - 7""")
def model13_anchor_rows(spark: SparkSession, d: str) -> DataFrame:
    """The row that a forecast for each week would have: the anchor's features, re-dated, persistence recomputed."""
    rows = backtest.training_frame(raw(spark, d), cell_counts(spark, d))
    return rows.select(
        "site", iso("week").alias("week"), "da_raw", "last_observed", r6("weeks_since_spike"), "prev_obs_1", r6("roll_mean_4"), "month", r6("sin_day_of_year"))


@query()
def model14_tuned_sites(spark: SparkSession, d: str) -> DataFrame:
    """Tuned over every measured week with enough history, each predicted from what was known a week before."""
    anchors = backtest.test_anchors(raw(spark, d), EngineConfig(test_fraction=1.0))
    return backtest.tune(anchors, backtest.training_frame(raw(spark, d), cell_counts(spark, d))).select("site", "best", r6("r2"))


@query()
def model16_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return backtest.bootstrap_forecast(raw(spark, d), cell_counts(spark, d), _SITE, _DAY)


@query()
def model17_registry(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, m, text) for t, models in MODELS.items() for m, text in models.items()], "task string, model string, description string")


_XY = "SELECT l_quantity AS x, l_discount AS z, l_extendedprice AS y FROM lineitem"


@query(f"WITH d AS ({_XY}) SELECT 'l_quantity' AS feature, {q6('regr_slope(y, x)')} AS slope, {q6('2 * regr_slope(y, x) ** 2 * var_pop(x) / var_pop(y)')} AS permutation FROM d")
def model20_permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    return E.linear_sensitivity(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]).select("feature", r6("slope"), r6("permutation"))


_PLANE = f"""{WEEKLY}, l AS (SELECT da_raw AS y, lag(da_raw) OVER (PARTITION BY site ORDER BY week) AS previous, month(week) AS month FROM weekly),
v AS (SELECT var_pop(y) AS vy, var_pop(previous) AS v1, var_pop(month) AS v2, covar_pop(previous, month) AS c, covar_pop(previous, y) AS c1, covar_pop(month, y) AS c2,
      max(previous) - min(previous) AS r1, max(month) - min(month) AS r2 FROM l WHERE previous IS NOT NULL),
b AS (SELECT *, (c1 * v2 - c2 * c) / (v1 * v2 - c * c) AS b1, (c2 * v1 - c1 * c) / (v1 * v2 - c * c) AS b2 FROM v),
p AS (SELECT 'previous' AS feature, b1 AS slope, 2 * b1 ** 2 * v1 / vy AS permutation, (b1 * r1) ** 2 / ((b1 * r1) ** 2 + (b2 * r2) ** 2) AS first_order FROM b
      UNION ALL SELECT 'month', b2, 2 * b2 ** 2 * v2 / vy, (b2 * r2) ** 2 / ((b1 * r1) ** 2 + (b2 * r2) ** 2) FROM b)"""


@query(f"WITH {_PLANE} SELECT feature, {q6('slope')} AS slope, {q6('permutation')} AS permutation, {q6('first_order')} AS first_order FROM p")
def model21_first_order_indices(spark: SparkSession, d: str) -> DataFrame:
    """How the weekly maximum depends on the one before and on the month."""
    before = F.lag("da_raw").over(Window.partitionBy("site").orderBy("week"))
    rows = weekly(spark, d).withColumns({"previous": before, "month": F.month("week")})
    found = E.linear_sensitivity(rows, "da_raw", ["previous", "month"])
    return found.select("feature", r6("slope"), r6("permutation"), r6("first_order"))


# -- experiments ---------------------------------------------------------------------------------

_SEEDS = (0, 1, 2, 3, 4)
_RUNS = WEEKLY + """, drawn AS (
  SELECT site, seed, abs(da_raw - p) AS e FROM (SELECT site, week, da_raw, p, unnest([0, 1, 2, 3, 4]) AS seed FROM (SELECT *, lag(da_raw) OVER (PARTITION BY site ORDER BY week) AS p FROM weekly))
  WHERE p IS NOT NULL AND md5(site || '|' || week::VARCHAR || '|' || seed::VARCHAR) < '8'
)"""


@query(f"""WITH {_RUNS}, per AS (SELECT site, avg(e) AS mae FROM drawn GROUP BY site, seed UNION ALL SELECT 'pooled', avg(e) FROM drawn GROUP BY seed)
SELECT site, count(*) AS seeds, {q6('avg(mae)')} AS mean, {q6('stddev_pop(mae)')} AS noise, bool_and(mae > 10) AS always_above, bool_and(mae < 10) AS always_below FROM per GROUP BY site""")
def exp04_seed_stability(spark: SparkSession, d: str) -> DataFrame:
    """The noise floor of persistence over seeds, by site and pooled."""
    return E.stability(E.seeded_scores(weekly(spark, d), _SEEDS), 10.0).select("site", "seeds", r6("mean"), r6("noise"), "always_above", "always_below")


@query(f"""WITH {_LONG}, m AS (SELECT model, {_REG} FROM long WHERE predicted IS NOT NULL GROUP BY model), b AS (SELECT mae AS base FROM m WHERE model = 'blend')
SELECT model, mae, {q6('mae - base')} AS delta, CASE WHEN mae - base > 1 THEN 'keep' WHEN mae - base > 0 THEN 'blend?' ELSE 'baseline' END AS verdict FROM m, b""")
def exp01_against_baseline(spark: SparkSession, d: str) -> DataFrame:
    found = M.regression_metrics(_long(spark, d), ["model"]).select("model", r6("mae"))
    return E.against_baseline(found, "model", "blend", "mae").select("model", "mae", r6("delta"), "verdict")


_STORED = {"ensemble": "prediction", "xgboost": "xgb_prediction", "rf": "rf_prediction", "naive": "naive_prediction"}
_COMBINED = " UNION ALL ".join(f"SELECT '{t}' AS task, '{m}' AS model, actual, {c} AS p FROM results WHERE {c} IS NOT NULL" for t in ("regression", "classification") for m, c in _STORED.items())


@query(f"""WITH {RESULTS}, c AS ({_COMBINED}) SELECT task, model, count(*) AS n, {q6('avg(abs(actual - p))')} AS mae,
count(*) FILTER (WHERE p > 20) AS high_or_more FROM c GROUP BY 1, 2""")
def exp07_precompute(spark: SparkSession, d: str) -> DataFrame:
    """All tasks and models of the stored forecasts, written by both and summed up from what was written."""
    rows = results(spark, d).withColumnRenamed("date", "test_date")
    path = scratch(spark, "precomputed")
    stored = backtest.precompute(rows, _STORED, path)
    discard_at_end(spark, path)
    return stored.groupBy("task", "model").agg(
        F.count("*").alias("n"), r6(F.avg(F.abs(F.col("actual") - F.col("predicted"))), "mae"), F.count_if(F.col("predicted_category") >= 2).alias("high_or_more"))


# -- service queries -----------------------------------------------------------------------------


_PAIRS = (("da_raw", "pn"), ("da_raw", "month"), ("pn", "month"))
_VARIES = "count(*) FILTER (WHERE {0} IS NOT NULL AND {1} IS NOT NULL) >= 3 AND var_pop({0}) FILTER (WHERE {1} IS NOT NULL) > 1e-12 AND var_pop({1}) FILTER (WHERE {0} IS NOT NULL) > 1e-12"
_CELLS = " UNION ALL ".join(
    f"SELECT site, '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
    f"{q6(f'CASE WHEN {_VARIES.format(a, b)} THEN covar_pop({a}, {b}) / sqrt(var_pop({a}) FILTER (WHERE {b} IS NOT NULL) * var_pop({b}) FILTER (WHERE {a} IS NOT NULL)) END')} AS r FROM both_series GROUP BY site"
    for a, b in _PAIRS)


@query(f"""WITH {SERIES}, {PN}, wpn AS (SELECT site, CAST(date_trunc('week', date) AS DATE) AS week, max(pn) AS pn FROM pn GROUP BY 1, 2),
both_series AS (SELECT site, da_raw, pn, month(week)::DOUBLE AS month FROM series LEFT JOIN wpn USING (site, week)) {_CELLS}""")
def api_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of each site's series: toxin, cells and month."""
    both = series(spark, d).join(weekly_max(cell_counts(spark, d), "pn"), ["site", "week"], "left").withColumn("month", F.month("week"))
    return A.correlations_by(both, ["site"], ["da_raw", "pn", "month"]).select("site", "a", "b", "n", r6("r"))


@query(f"WITH {WEEKLY} SELECT site, week::VARCHAR AS week, da_raw FROM (SELECT * FROM weekly WHERE week BETWEEN DATE '2010-01-01' AND DATE '2015-12-31' ORDER BY week DESC, site LIMIT 1000)")
def api_historical_all(spark: SparkSession, d: str) -> DataFrame:
    return historical(weekly(spark, d), first=date(2010, 1, 1), last=date(2015, 12, 31), limit=1000).select("site", iso("week").alias("week"), "da_raw")


def historical(rows: DataFrame, *, site: str | None = None, first: date | None = None, last: date | None = None, limit: int | None = None) -> DataFrame:
    """The latest ``limit`` weeks of one site or of all, between two dates, both included; None leaves a bound out."""
    kept = rows
    for column, condition in ((site, F.col("site") == site), (first, F.col("week") >= F.lit(first)), (last, F.col("week") <= F.lit(last))):
        kept = kept if column is None else kept.where(condition)
    return kept if limit is None else kept.orderBy(F.desc("week"), "site").limit(limit)


@query(f"WITH {RAW} SELECT site, replace(site, ' ', '-') AS slug, count(*) AS n FROM raw GROUP BY 1")
def api_sites(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).groupBy("site").agg(F.count("*").alias("n")).select("site", F.replace(F.col("site"), F.lit(" "), F.lit("-")).alias("slug"), "n")


@query(f"WITH {WEEKLY} SELECT site, week::VARCHAR AS week, da_raw FROM (SELECT * FROM weekly WHERE site = 'copalis' AND week BETWEEN DATE '2005-01-01' AND DATE '2020-12-31' ORDER BY week DESC LIMIT 1000)")
def api_historical_site(spark: SparkSession, d: str) -> DataFrame:
    rows = historical(weekly(spark, d), site="copalis", first=date(2005, 1, 1), last=date(2020, 12, 31), limit=1000)
    return rows.select("site", iso("week").alias("week"), "da_raw")


@query(f"""WITH {RAW}, latest AS (SELECT site, arg_max(da_raw, (t, sample_id)) AS da FROM raw GROUP BY site), place AS (SELECT {KEY} AS site, avg(lat) AS lat, avg(lon) AS lon FROM site_profiles WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1)
SELECT p.site, {q6('lat')} AS lat, {q6('lon')} AS lon, da, CASE WHEN da < 5 THEN 'Low' WHEN da < 20 THEN 'Moderate' WHEN da < 40 THEN 'High' WHEN da >= 40 THEN 'Extreme' ELSE 'No Data' END AS risk,
       CASE WHEN da < 5 THEN 'green' WHEN da < 20 THEN 'yellow' WHEN da < 40 THEN 'orange' WHEN da >= 40 THEN 'red' ELSE 'gray' END AS colour FROM place p LEFT JOIN latest USING (site)""")
def api_map(spark: SparkSession, d: str) -> DataFrame:
    newest = A.latest(raw(spark, d), "site", ["t", "sample_id"], ["da_raw"]).withColumnRenamed("da_raw", "da")
    place = table(spark, d, "site_profiles").where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(site_key(F.col("site")).alias("site")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return place.join(newest, "site", "left").select("site", r6("lat"), r6("lon"), "da", C.risk_label(F.col("da")).alias("risk"), C.risk_colour(F.col("da")).alias("colour"))


_C4 = "CASE WHEN {0} <= 5 THEN 0 WHEN {0} <= 20 THEN 1 WHEN {0} <= 40 THEN 2 ELSE 3 END"
_NAMED = ("low", "moderate", "high", "extreme")
_SCORES = ", ".join(
    f"{q6(f'CASE WHEN c{k} > 0 THEN t{k} / c{k} ELSE 0 END')} AS {n}_precision, {q6(f'CASE WHEN s{k} > 0 THEN t{k} / s{k} ELSE 0 END')} AS {n}_recall, "
    f"{q6(f'CASE WHEN c{k} + s{k} > 0 THEN 2 * t{k} / (c{k} + s{k}) ELSE 0 END')} AS {n}_f1, s{k} AS {n}_support" for k, n in enumerate(_NAMED))
_CALLS = ", ".join(f"count(*) FILTER (WHERE ac = {k}) AS s{k}, count(*) FILTER (WHERE pc = {k}) AS c{k}, count(*) FILTER (WHERE ac = {k} AND pc = {k}) AS t{k}" for k in range(4))
_BALANCED = " + ".join(f"CASE WHEN s{k} > 0 THEN t{k} / s{k} ELSE 0 END" for k in range(4))
_PRESENT = " + ".join(f"(s{k} > 0)::INT" for k in range(4))


@query(f"""WITH {RESULTS}, r AS (SELECT actual, naive_prediction AS p, {_C4.format('actual')} AS ac, {_C4.format('naive_prediction')} AS pc FROM results WHERE naive_prediction IS NOT NULL),
c AS (SELECT count(*) AS total_forecasts, 1 - sum((actual - p) ** 2) / (var_pop(actual) * count(*)) AS r2, avg(abs(actual - p)) AS mae, avg((ac = pc)::INT) AS accuracy,
count(*) FILTER (WHERE actual > 20 AND p > 20) AS tp, count(*) FILTER (WHERE actual > 20) AS n_spikes, count(*) FILTER (WHERE p > 20) AS n_called, {_CALLS} FROM r)
SELECT total_forecasts, {q6('r2')} AS r2_score, {q6('mae')} AS mae, {q6('CASE WHEN n_spikes + n_called > 0 THEN 2 * tp / (n_spikes + n_called) ELSE 0 END')} AS f1_score,
{q6('accuracy')} AS accuracy, {q6(f'({_BALANCED}) / ({_PRESENT})')} AS balanced_accuracy, {_SCORES} FROM c""")
def api_retrospective(spark: SparkSession, d: str) -> DataFrame:
    """The summary of stored forecasts, here of their naive predictions."""
    rows = results(spark, d).select("actual", F.col("naive_prediction").alias("predicted"))
    found = backtest.summary(rows.withColumns({f"{c}_category": C.category_right_closed(F.col(c)) for c in ("actual", "predicted")}))
    return found.select(*[r6(c) if t == "double" else F.col(c) for c, t in found.dtypes])


# -- streams -------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*").parquet(d)


@query("SELECT event_type AS site, date_trunc('week', ts)::DATE::VARCHAR AS week, max(value) AS value FROM events GROUP BY 1, 2")
def stream01_weekly_max(spark: SparkSession, d: str) -> DataFrame:
    stream = weekly_max_stream(_stream(spark, d, "events"), site="event_type", moment="ts", value="value")
    return run_updates(stream, f"weekly_{uuid.uuid4().hex}", ["site", "week"], "value").select("site", iso("week").alias("week"), "value")


@query("SELECT event_id, value >= 12 AS spike_alert FROM events")
def stream02_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "events").withColumn("p", F.lit(None).cast("double"))
    return run_once(alert_stream(rows, probability="p", prediction="value").select("event_id", "spike_alert"), f"alerts_{uuid.uuid4().hex}")


@query(f"""WITH timed AS (SELECT event_type AS site, ts AS t, value, event_id FROM events), w AS (
  SELECT *, lag(value, 1 IGNORE NULLS) OVER o AS last_observed, max(CASE WHEN value > 20 THEN t END) OVER (PARTITION BY site ORDER BY t, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spiked
  FROM timed WINDOW o AS (PARTITION BY site ORDER BY t, value)
)
SELECT site, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS t, value, {q6("last_observed")} AS last_observed, {q6("(epoch_us(t) - epoch_us(spiked)) / 86400000000.0")} AS days_since_spike FROM w""")
def stream03_persistence(spark: SparkSession, d: str) -> DataFrame:
    stream = persistence_stream(_stream(spark, d, "events"), site="event_type", moment="ts", value="value")
    found = run_once(stream, f"persistence_{uuid.uuid4().hex}")
    return found.select("site", F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), "value", r6("last_observed"), r6("days_since_spike"))


@query(f"""WITH m AS (SELECT date_trunc('month', ts)::DATE AS m, avg(value) AS idx FROM events GROUP BY 1)
SELECT event_id, {q6('idx')} AS idx FROM events LEFT JOIN m ON m.m = (date_trunc('month', ts) - INTERVAL 1 MONTH)::DATE""")
def stream04_delayed_month(spark: SparkSession, d: str) -> DataFrame:
    """Events as they come, with last month's mean."""
    index = table(spark, d, "events").groupBy(F.trunc("ts", "month").alias("m")).agg(F.avg("value").alias("idx"))
    met = delayed_month_stream(_stream(spark, d, "events").select("event_id", "ts"), index, moment="ts", month="m", months_back=1, payload=["idx"])
    return run_once(met.select("event_id", "idx"), f"delayed_{uuid.uuid4().hex}").select("event_id", r6("idx"))
