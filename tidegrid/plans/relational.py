"""Scans, projections, joins, aggregates, orderings, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.functions import classes as C
from tidegrid.functions.scalars import monday, reading_value, site_key
from tidegrid.operators import aggregates as A
from tidegrid.operators.dirty_rows import parse_lines
from tidegrid.operators.joins import asof_join, delayed_month_join, leakage_report, training_rows
from tidegrid.operators.series import lattice, month_shift, weekly_max
from tidegrid.operators.windows import expanding_history, hashed_sample, history_counts, with_known_weeks
from tidegrid.plans.base import KEY, PN, RAW, RESULTS, SERIES, WEEKLY, Catalogue, cell_counts, iso, q6, r6, raw, results, series, weekly
from tidegrid.plans.problems_sql import _LINES
from tidegrid.runtime import table
from tidegrid.sources import cache, files

CATALOGUE = Catalogue()
query = CATALOGUE.add


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR = ", ".join(f"round(corr({a}, {b}) + 1e-9, 6) AS \"{a}|{b}\"" for a in _NUM for b in _NUM)


# -- sources and sinks -------------------------------------------------------------------------


@query(f"WITH {RAW} SELECT sample_id, site, strftime(date, '%Y-%m-%d') AS date, da_raw FROM raw")
def src01_raw_series(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("sample_id", "site", iso("date").alias("date"), "da_raw")


@query(f"""WITH {_LINES}, typed AS (
  SELECT line_id, day, CASE WHEN NOT starts_with(result, '<') AND result <> '' THEN TRY_CAST(replace(result, ',', '') AS DOUBLE) END AS v FROM judged WHERE reason IS NULL
) SELECT list_aggregate(list_transform(string_split(regexp_replace(regexp_replace(file_name, '\\.csv$', ''), '[-_](da|pn)$', ''), '-'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS site,
  day::VARCHAR AS date, count(*) AS n, {q6("sum(v)")} AS total FROM typed JOIN da_file_lines USING (line_id) WHERE v IS NOT NULL GROUP BY 1, 2""")
def src01_file_series(spark: SparkSession, d: str) -> DataFrame:
    """The measurements of all delivered files of both layouts, bad rows among them, by site and date."""
    parsed = parse_lines(table(spark, d, "da_file_lines"), keep=["file_name"])
    rows = files.series_of_lines(parsed, "file_name").groupBy("site", iso("date").alias("date"))
    return rows.agg(F.count("*").alias("n"), r6(F.sum("da_raw"), "total"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src02_csv_to_parquet(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier")
    written = files.write_csv(suppliers, files.scratch(spark, "csv"))
    return spark.read.parquet(files.csv_to_parquet(spark, written, files.scratch(spark, "parquet"), suppliers.schema))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 25")
def src03_parquet_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size > 25").select("p_partkey", "p_brand", "p_size")


@query("""WITH pairs AS (SELECT DISTINCT user_id, event_type FROM events),
months AS (SELECT CAST(unnest(generate_series(DATE '2023-11-01', DATE '2024-03-01', INTERVAL 1 MONTH)) AS DATE) AS m)
SELECT user_id, event_type, strftime(greatest(m, DATE '2023-11-15'), '%Y-%m-%d') AS chunk_start,
       strftime(least(CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), DATE '2024-03-10'), '%Y-%m-%d') AS chunk_end,
       'feed/' || event_type || '?from=' || strftime(greatest(m, DATE '2023-11-15'), '%Y-%m-%d') AS url FROM pairs, months""")
def src05_chunked_tasks(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "events").select("user_id", "event_type").distinct()
    return files.month_chunks(pairs, "2023-11-15", "2024-03-10", F.concat(F.lit("feed/"), "event_type", F.lit("?from={start_date}")))


@query(f"SELECT user_id, event_type, ts, {q6('avg(value)')} AS mean_value FROM events GROUP BY 1, 2, 3")
def src06_spatial_mean(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_by(table(spark, d, "events"), ["user_id", "event_type", "ts"], "value", "mean_value")


@query(f"SELECT event_type, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, {q6('avg(value)')} AS index_value FROM events GROUP BY 1, 2")
def src07_monthly_index(spark: SparkSession, d: str) -> DataFrame:
    monthly = table(spark, d, "events").withColumn("month", F.trunc("ts", "month"))
    return A.mean_by(monthly, ["event_type", "month"], "value", "index_value").withColumn("month", iso("month"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 0")
def src08_nested_json(spark: SparkSession, d: str) -> DataFrame:
    wrapped = table(spark, d, "events").select("event_id", F.concat(
        F.lit('{"value":{"timeSeries":[{"variable":{"variableCode":[{"value":"00010"}]},"values":[{"value":[]}]},'
              '{"variable":{"variableCode":[{"value":"00060"}]},"values":[{"value":[{"dateTime":"2020-01-01T00:00:00","value":"'),
        F.get_json_object("props", "$.k"), F.lit('"},{"dateTime":"2020-01-02T00:00:00","value":"-999"}]}]}]}}'),
    ).alias("body"))
    flow = files.parse_flow_json(wrapped, "body", code="00060")
    return flow.select("event_id", F.col("value").cast("long").alias("k"))


_IDW = """grid AS (
  SELECT year(valid_from) AS y, lat, avg(spike_threshold) AS v FROM site_profiles WHERE lat IS NOT NULL AND valid_from IS NOT NULL AND spike_threshold IS NOT NULL GROUP BY 1, 2
), targets AS (SELECT site, min(lat) AS lat0 FROM site_profiles WHERE lat IS NOT NULL GROUP BY site)"""


@query(f"""WITH {_IDW}, years AS (SELECT DISTINCT y FROM grid), each AS (
  SELECT site, y, v, abs(lat - lat0) <= 1e-8 + 1e-5 * abs(lat0) AS hit, 1 / (abs(lat - lat0) ** 2 + 1e-9) AS w FROM targets, grid
)
SELECT site, CAST(y AS INTEGER) AS y, {q6('CASE WHEN bool_or(hit) THEN avg(v) FILTER (WHERE hit) ELSE sum(v * w) / sum(w) END')} AS interpolated FROM each GROUP BY 1, 2""")
def agg11_idw(spark: SparkSession, d: str) -> DataFrame:
    profiles = table(spark, d, "site_profiles").where("lat IS NOT NULL")
    grid = profiles.where("valid_from IS NOT NULL AND spike_threshold IS NOT NULL").groupBy(F.year("valid_from").alias("y"), "lat").agg(F.avg("spike_threshold").alias("v"))
    targets = profiles.groupBy("site").agg(F.min("lat").alias("lat0"))
    return A.inverse_distance(grid, targets, period="y", lat="lat", value="v", target="site", target_lat="lat0").select("site", "y", r6("interpolated"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src10_parquet_sink(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(files.write_parquet(table(spark, d, "nation"), files.scratch(spark, "nation")))


@query("SELECT r_regionkey, r_name FROM region")
def src12_json_sink(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "region")
    return spark.read.schema(regions.schema).json(files.write_json(regions, files.scratch(spark, "region")))


_CACHE = """entries AS (
  SELECT 'retrospective:' || task || ':' || coalesce(model, 'ensemble') AS key, count(*) AS n, max(answered_at) AS written FROM forecast_responses WHERE answered_at IS NOT NULL GROUP BY 1
)"""


@query(f"WITH {_CACHE} SELECT key, n FROM entries WHERE key LIKE 'retrospective:regression:%' AND written + INTERVAL 7 DAY > TIMESTAMP '2023-12-01 00:00:00'")
def src13_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "forecast_responses").where("answered_at IS NOT NULL")
    key = F.concat(F.lit("retrospective:"), "task", F.lit(":"), F.coalesce("model", F.lit("ensemble")))
    entries = answers.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.max("answered_at").alias("written"))
    return cache.live(cache.with_expiry(entries, "written"), "2023-12-01", "retrospective:regression:*").select("key", "n")


@query(f"WITH {WEEKLY} SELECT site, count(*) AS weeks FROM weekly GROUP BY site")
def src14_load_or_run(spark: SparkSession, d: str) -> DataFrame:
    """Run and stored, then asked for again, which loads it."""
    run = lambda: weekly(spark, d).groupBy("site").agg(F.count("*").alias("weeks"))
    wanted = {"what": "weeks", "data": d}
    cache.load_or_run(spark, wanted, run, refresh=True, keep=False)
    return cache.load_or_run(spark, wanted, lambda: run().limit(0))


@query(f"WITH m AS (SELECT {_CORR} FROM lineitem) SELECT string_split(pair, '|')[1] AS a, string_split(pair, '|')[2] AS b, r FROM (UNPIVOT m ON COLUMNS(*) INTO NAME pair VALUE r)")
def src15_matrix_to_long(spark: SparkSession, d: str) -> DataFrame:
    """A stored correlation matrix, a row and a column per name, read back and unpivoted."""
    found = A.correlation_matrix(table(spark, d, "lineitem").select(*_NUM)).groupBy("a").pivot("b", _NUM).agg(F.first("r"))
    stored = spark.read.schema(found.schema).json(files.write_json(found, files.scratch(spark, "matrix")))
    return A.matrix_to_long(stored, "a").select("a", "b", r6("r"))


@query()
def agg28_total_size(spark: SparkSession, d: str) -> DataFrame:
    return cache.manifest(spark, d).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query()
def src16_manifest(spark: SparkSession, d: str) -> DataFrame:
    return cache.manifest(spark, d)


@query(f"""SELECT DISTINCT ON (k) k AS site, strftime(collect_date, '%Y-%m-%d %H:%M:%S') AS collected, x AS da FROM (
  SELECT {KEY} AS k, collect_date, sample_id, (CASE WHEN starts_with(s, '<') THEN 0.5 ELSE 1.0 END) * CAST(regexp_extract(s, '[0-9]+(\\.[0-9]+)?') AS DOUBLE) AS x
  FROM (SELECT *, trim(domoic_result, chr(32) || chr(9) || chr(13)) AS s FROM da_samples)
  WHERE site IS NOT NULL AND collect_date IS NOT NULL AND regexp_full_match(s, '(<[ \\t\\r]*)?[0-9]+(\\.[0-9]+)?')
) ORDER BY k, collect_date DESC, sample_id DESC""")
def src18_latest_per_site(spark: SparkSession, d: str) -> DataFrame:
    latest = A.latest(raw(spark, d, "half"), "site", ["t", "sample_id"], ["t", "da_raw"])
    return latest.select("site", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("collected"), F.col("da_raw").alias("da"))


@query(f"WITH {RAW} SELECT count(DISTINCT site) AS sites, strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date, count(*) AS n FROM raw")
def src20_metadata(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).agg(
        F.count_distinct("site").alias("sites"), iso(F.min("date")).alias("first_date"), iso(F.max("date")).alias("last_date"), F.count("*").alias("n")
    )


# -- projections and filters --------------------------------------------------------------------


@query(f"WITH {RAW} SELECT sample_id, da_raw FROM raw WHERE site = 'copalis'")
def proj01_site_filter(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).where("site = 'copalis'").select("sample_id", "da_raw")


@query(f"WITH {RAW} SELECT sample_id, site FROM raw WHERE date BETWEEN DATE '2010-01-01' AND DATE '2012-12-31'")
def proj02_date_range(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).where(F.col("date").between("2010-01-01", "2012-12-31")).select("sample_id", "site")


@query(f"WITH {RESULTS} SELECT response_id FROM results WHERE date >= DATE '2019-01-01'")
def proj04_holdout(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).where("date >= DATE '2019-01-01'").select("response_id")


@query("SELECT sample_id FROM da_samples WHERE site IS NOT NULL AND collect_date IS NOT NULL AND domoic_result IS NOT NULL")
def proj05_null_rejection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "da_samples").dropna(subset=["site", "collect_date", "domoic_result"]).select("sample_id")


@query("SELECT sample_id, v FROM (SELECT sample_id, TRY_CAST(domoic_result AS DOUBLE) AS v FROM da_samples WHERE regexp_full_match(domoic_result, '-?[0-9.]+')) WHERE v >= 0")
def proj06_non_negative(spark: SparkSession, d: str) -> DataFrame:
    numbers = table(spark, d, "da_samples").where(F.col("domoic_result").rlike(r"^-?[0-9.]+$"))
    return numbers.select("sample_id", F.col("domoic_result").try_cast("double").alias("v")).where("v >= 0")


@query(f"WITH {SERIES} SELECT site, strftime(week, '%Y-%m-%d') AS week, da_raw, da_raw IS NULL AS is_interpolated FROM series")
def proj07_observed_flag(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).select("site", iso("week").alias("week"), "da_raw", F.col("da_raw").isNull().alias("is_interpolated"))


_HISTORY = WEEKLY + """, per AS (SELECT site, date, count(*) AS n FROM raw GROUP BY 1, 2),
hist AS (SELECT site, date, coalesce(sum(n) OVER (PARTITION BY site ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 7 DAY PRECEDING), 0) AS n_history FROM per),
total AS (SELECT site, count(*) AS n_site FROM raw GROUP BY site)"""


@query(f"""WITH {_HISTORY}, wk AS (SELECT site, date, (SELECT count(*) FROM weekly w WHERE w.site = per.site AND w.week <= CAST(per.date - 7 AS DATE)) AS n_weeks FROM per)
SELECT r.sample_id, CAST(h.n_history AS BIGINT) AS n_history FROM raw r JOIN hist h USING (site, date) JOIN total USING (site) JOIN wk USING (site, date)
WHERE h.n_history >= greatest(ceil(0.33 * n_site), 10) AND n_weeks >= 10""")
def proj09_history_requirement(spark: SparkSession, d: str) -> DataFrame:
    """Enough rows, and ten observed weeks, at least a week before."""
    rows = with_known_weeks(raw(spark, d), weekly(spark, d)).where("n_weeks >= 10")
    everything = raw(spark, d)
    sizes = everything.groupBy("site").agg(F.count("*").alias("n_site"))
    counted = history_counts(everything).join(rows.select("sample_id"), "sample_id").join(sizes, "site")
    return counted.where(F.col("n_history") >= F.greatest(F.ceil(F.lit(0.33) * F.col("n_site")), F.lit(10))).select("sample_id", "n_history")


@query(f"WITH {WEEKLY} SELECT site, count(*) AS n FROM weekly GROUP BY site HAVING count(*) >= 30")
def proj10_minimum_size(spark: SparkSession, d: str) -> DataFrame:
    return weekly(spark, d).groupBy("site").agg(F.count("*").alias("n")).where("n >= 30")


@query(f"WITH {RAW} SELECT sample_id, site FROM raw WHERE site IN ('copalis', 'long beach', 'clatsop beach')")
def proj12_in_list(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).where(F.col("site").isin("copalis", "long beach", "clatsop beach")).select("sample_id", "site")


@query("SELECT c_custkey AS id, c_name AS label, c_acctbal AS balance FROM customer")
def proj15_rename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").withColumnsRenamed({"c_custkey": "id", "c_name": "label", "c_acctbal": "balance"})


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def proj17_numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    return A.numeric_only(table(spark, d, "lineitem"))


@query("SELECT response_id, success FROM forecast_responses WHERE NOT success")
def proj18_drop_empty_columns(spark: SparkSession, d: str) -> DataFrame:
    failed = table(spark, d, "forecast_responses").where("NOT success").select("response_id", "success", "prediction", "xgb_prediction", "rf_prediction")
    return A.drop_empty_columns(failed)


@query("SELECT response_id, coalesce(prediction, naive_prediction) AS value, coalesce(rf_prediction, 0) AS rf FROM forecast_responses")
def proj22_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "forecast_responses").select(
        "response_id", F.coalesce("prediction", "naive_prediction").alias("value"), F.coalesce("rf_prediction", F.lit(0.0)).alias("rf")
    )


@query("""SELECT response_id, CASE model WHEN 'xgboost' THEN xgb_prediction WHEN 'rf' THEN rf_prediction WHEN 'naive' THEN naive_prediction
       WHEN 'linear' THEN prediction ELSE coalesce(0.56 * xgb_prediction + 0.44 * rf_prediction, prediction) END AS chosen FROM forecast_responses""")
def proj23_primary_prediction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "forecast_responses").select("response_id", C.primary_prediction(
        F.col("model"), ensemble=F.coalesce(0.56 * F.col("xgb_prediction") + 0.44 * F.col("rf_prediction"), "prediction"), boosted=F.col("xgb_prediction"),
        forest=F.col("rf_prediction"), naive=F.col("naive_prediction"), linear=F.col("prediction"),
    ).alias("chosen"))


# -- joins --------------------------------------------------------------------------------------

_MONTHLY = "monthly AS (SELECT CAST(date_trunc('month', date) AS DATE) AS m, avg(pn) AS idx FROM pn GROUP BY 1)"


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    return cell_counts(spark, d).groupBy(F.trunc("date", "month").alias("m")).agg(F.avg("pn").alias("idx"))


@query(f"WITH {WEEKLY}, {PN}, {_MONTHLY} SELECT site, strftime(week, '%Y-%m-%d') AS week, {q6('idx')} AS idx FROM weekly LEFT JOIN monthly ON m = CAST(date_trunc('month', week) - INTERVAL 2 MONTH AS DATE)")
def join01_shifted_month(spark: SparkSession, d: str) -> DataFrame:
    met = delayed_month_join(weekly(spark, d), _monthly(spark, d), day="week", month="m", months_back=2, payload=["idx"])
    return met.select("site", iso("week").alias("week"), r6("idx"))


_ASOF = f"WITH {WEEKLY}, {PN}, best AS (SELECT site, t, max(pn) AS pn FROM pn GROUP BY 1, 2)"


@query(f"""{_ASOF}, daily AS (SELECT CAST(date AS TIMESTAMP) AS dt, max(pn) AS flow FROM pn GROUP BY 1)
SELECT site, strftime(week, '%Y-%m-%d') AS week, CASE WHEN epoch_us(CAST(week AS TIMESTAMP)) - epoch_us(dt) <= 7 * 86400000000 THEN flow END AS flow
FROM weekly ASOF LEFT JOIN daily ON dt <= CAST(week AS TIMESTAMP)""")
def join02_asof_no_key(spark: SparkSession, d: str) -> DataFrame:
    """The series without key meets the distinct weeks, and these their sites: only they share one key."""
    daily = cell_counts(spark, d).groupBy(F.col("date").alias("dt")).agg(F.max("pn").alias("flow")).withColumn("all_sites", F.lit(1))
    rows = weekly(spark, d)
    weeks = rows.select("week").distinct().withColumn("all_sites", F.lit(1))
    met = asof_join(weeks, daily, by=["all_sites"], left_on="week", right_on="dt", payload=["flow"], tolerance_days=7)
    return rows.join(met.select("week", "flow"), "week").select("site", iso("week").alias("week"), "flow")


@query(f"""{_ASOF} SELECT w.site, strftime(week, '%Y-%m-%d') AS week, CASE WHEN epoch_us(CAST(week AS TIMESTAMP)) - 7 * 86400000000 - epoch_us(b.t) <= 7 * 86400000000 THEN b.pn END AS pn
FROM weekly w ASOF LEFT JOIN best b ON w.site = b.site AND b.t <= CAST(w.week AS TIMESTAMP) - INTERVAL 7 DAY""")
def join03_asof_delayed(spark: SparkSession, d: str) -> DataFrame:
    met = asof_join(weekly(spark, d), cell_counts(spark, d), by=["site"], left_on="week", right_on="t", payload=["pn"], tolerance_days=7, delay_days=7)
    return met.select("site", iso("week").alias("week"), "pn")


@query(f"""WITH {WEEKLY}, {PN}, {_MONTHLY} SELECT site, strftime(week, '%Y-%m-%d') AS week, {q6('coalesce(a.idx, b.idx)')} AS anomaly FROM weekly
LEFT JOIN monthly a ON a.m = CAST(date_trunc('month', week) - INTERVAL 2 MONTH AS DATE) LEFT JOIN monthly b ON b.m = CAST(date_trunc('month', week) - INTERVAL 1 MONTH AS DATE)""")
def join04_month_fallback(spark: SparkSession, d: str) -> DataFrame:
    first = delayed_month_join(weekly(spark, d), _monthly(spark, d).withColumnRenamed("idx", "first"), day="week", month="m", months_back=2, payload=["first"])
    both = delayed_month_join(first, _monthly(spark, d).withColumnRenamed("idx", "second"), day="week", month="m", months_back=1, payload=["second"])
    return both.select("site", iso("week").alias("week"), r6(F.coalesce("first", "second"), "anomaly"))


@query(f"WITH {SERIES}, {PN}, wpn AS (SELECT site, CAST(date_trunc('week', date) AS DATE) AS week, max(pn) AS pn FROM pn GROUP BY 1, 2) SELECT site, strftime(week, '%Y-%m-%d') AS week, da_raw, pn FROM series LEFT JOIN wpn USING (site, week)")
def join05_site_week(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).join(weekly_max(cell_counts(spark, d), "pn"), ["site", "week"], "left").select("site", iso("week").alias("week"), "da_raw", "pn")


@query(f"""WITH {RESULTS}, pairs AS (SELECT a.response_id AS a_id, b.response_id AS b_id, a.xgb_prediction AS p, b.naive_prediction AS q
FROM results a JOIN results b ON a.site = b.site AND a.date = b.date WHERE a.model = 'ensemble' AND b.model = 'naive' AND a.task = 'regression' AND b.task = 'regression')
SELECT *, (SELECT count(*) FROM pairs) >= 10 AS enough FROM pairs""")
def join06_paired_models(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).where("task = 'regression'")
    a = rows.where("model = 'ensemble'").select("site", "date", F.col("response_id").alias("a_id"), F.col("xgb_prediction").alias("p"))
    b = rows.where("model = 'naive'").select("site", "date", F.col("response_id").alias("b_id"), F.col("naive_prediction").alias("q"))
    pairs = a.join(b, ["site", "date"])
    # fewer pairs than ten say nothing of either model
    return pairs.select("a_id", "b_id", "p", "q", F.lit(pairs.limit(10).count() >= 10).alias("enough"))


@query("""SELECT r.response_id, r.model AS model_response, q.model AS model_request, q.task AS task_request FROM forecast_responses r LEFT JOIN forecast_requests q ON r.request_id = q.request_id""")
def join07_suffixed(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "forecast_requests").select("request_id", F.col("model").alias("model_request"), F.col("task").alias("task_request"))
    return table(spark, d, "forecast_responses").join(asked, "request_id", "left").select("response_id", F.col("model").alias("model_response"), "model_request", "task_request")


@query(f"""WITH {RESULTS} SELECT r.response_id, CASE WHEN r.date - 7 - w.week <= 28 THEN w.da_raw END AS anchor_value, CASE WHEN r.date - 7 - w.week <= 28 THEN strftime(w.week, '%Y-%m-%d') END AS anchor_week
FROM results r ASOF LEFT JOIN weekly w ON r.site = w.site AND w.week <= CAST(r.date - 7 AS DATE)""")
def join08_anchor_row(spark: SparkSession, d: str) -> DataFrame:
    met = asof_join(results(spark, d).select("response_id", "site", "date"), weekly(spark, d).withColumnRenamed("week", "w"), by=["site"], left_on="date", right_on="w",
                    payload=["da_raw"], tolerance_days=28, delay_days=7)
    return met.select("response_id", F.col("da_raw").alias("anchor_value"), iso("matched_on").alias("anchor_week"))


@query(f"""WITH {RESULTS}, ups AS (SELECT site, CAST(date AS DATE) AS d0, max(da_raw) AS v FROM raw GROUP BY 1, 2)
SELECT r.response_id, u.v AS previous, CAST(r.date - u.d0 AS INTEGER) AS gap_days, coalesce(u.v < 20 AND r.actual >= 20, false) AS is_transition
FROM results r ASOF LEFT JOIN ups u ON r.site = u.site AND u.d0 < r.date""")
def join09_strict_asof(spark: SparkSession, d: str) -> DataFrame:
    before = raw(spark, d).groupBy("site", F.col("date").alias("d0")).agg(F.max("da_raw").alias("v"))
    met = asof_join(results(spark, d).select("response_id", "site", "date", "actual"), before, by=["site"], left_on="date", right_on="d0", payload=["v"], strict=True)
    return met.select("response_id", F.col("v").alias("previous"), F.datediff("date", "matched_on").alias("gap_days"),
                      F.coalesce((F.col("v") < 20) & (F.col("actual") >= 20), F.lit(False)).alias("is_transition"))


@query(f"""WITH {RESULTS} SELECT r.response_id, coalesce(CASE WHEN r.date - 7 - w.week <= 365 THEN w.da_raw END, 0) AS naive
FROM results r ASOF LEFT JOIN weekly w ON r.site = w.site AND w.week <= CAST(r.date - 7 AS DATE)""")
def join10_last_known(spark: SparkSession, d: str) -> DataFrame:
    met = asof_join(results(spark, d).select("response_id", "site", "date"), weekly(spark, d).withColumnRenamed("week", "w"), by=["site"], left_on="date", right_on="w",
                    payload=["da_raw"], tolerance_days=365, delay_days=7)
    return met.select("response_id", F.coalesce("da_raw", F.lit(0.0)).alias("naive"))


@query(f"WITH {SERIES} SELECT site, strftime(week, '%Y-%m-%d') AS week FROM grid")
def join11_lattice(spark: SparkSession, d: str) -> DataFrame:
    return lattice(weekly(spark, d)).select("site", iso("week").alias("week"))


@query(f"SELECT sample_id FROM da_samples WHERE {KEY} IN (SELECT {KEY} FROM site_profiles)")
def join12_semi(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "site_profiles").select(site_key(F.col("site")).alias("k")).distinct()
    return table(spark, d, "da_samples").withColumn("k", site_key(F.col("site"))).join(known, "k", "left_semi").select("sample_id")


@query(f"WITH {_HISTORY} SELECT sample_id, CAST(n_history AS BIGINT) AS n_history FROM raw JOIN hist USING (site, date)")
def join13_history_count(spark: SparkSession, d: str) -> DataFrame:
    return history_counts(raw(spark, d)).select("sample_id", "n_history")


_ANCHORS = """anchors AS (
  SELECT site, week AS test_date, CAST(week - 7 AS DATE) AS anchor FROM weekly
), train AS (SELECT a.site, a.test_date, a.anchor, w.week, w.da_raw FROM anchors a JOIN weekly w ON a.site = w.site AND w.week <= a.anchor),
sized AS (SELECT *, count(*) OVER (PARTITION BY site, test_date) AS n FROM train)"""


def _at_every_week(spark: SparkSession, d: str) -> DataFrame:
    """Every observed week as a test date, with what its training window holds."""
    return expanding_history(weekly(spark, d))


@query(f"WITH {WEEKLY}, {_ANCHORS} SELECT site, strftime(test_date, '%Y-%m-%d') AS test_date, count(*) AS n, {q6('avg(da_raw)')} AS mean, {q6('quantile_cont(da_raw, 0.99)')} AS q99, {q6('median(da_raw)')} AS med FROM sized WHERE n >= 10 GROUP BY 1, 2")
def join14_training_windows(spark: SparkSession, d: str) -> DataFrame:
    return _at_every_week(spark, d).select("site", iso("test_date").alias("test_date"), "n", *[r6(c) for c in ("mean", "q99", "med")])


@query(f"""WITH {WEEKLY}, {_ANCHORS}, dates AS (SELECT DISTINCT anchor FROM anchors), totals AS (SELECT week, count(*) AS n, sum((da_raw >= 20)::INT) AS s FROM weekly GROUP BY week)
SELECT strftime(anchor, '%Y-%m-%d') AS anchor, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS spikes FROM dates JOIN totals ON week <= anchor GROUP BY 1""")
def join15_pooled_range(spark: SparkSession, d: str) -> DataFrame:
    rows = weekly(spark, d)
    dates = rows.select(F.date_sub("week", 7).alias("anchor")).distinct()
    totals = rows.groupBy("week").agg(F.count("*").alias("n"), F.sum((F.col("da_raw") >= 20).cast("int")).alias("s"))
    return A.running_totals_at(dates, "anchor", totals, "week", ["n", "s"]).select(iso("anchor").alias("anchor"), "n", F.col("s").alias("spikes"))


@query(f"WITH {WEEKLY}, {_ANCHORS} SELECT site, strftime(test_date, '%Y-%m-%d') AS test_date, strftime(max(week), '%Y-%m-%d') AS last_train, max(week) <= max(anchor) AND max(test_date) > max(anchor) AS clean FROM sized WHERE n >= 10 GROUP BY 1, 2")
def proj25_leakage_check(spark: SparkSession, d: str) -> DataFrame:
    """The check sees the joined rows, summed up before any shuffle."""
    rows = weekly(spark, d)
    anchors = rows.select("site", F.col("week").alias("test_date"), F.date_sub("week", 7).alias("anchor"))
    checked = leakage_report(training_rows(anchors, rows), keys=["site", "test_date"], min_rows=10)
    return checked.select("site", iso("test_date").alias("test_date"), iso("last_train").alias("last_train"), "clean")


@query(f"""WITH {WEEKLY}, first_site AS (SELECT lat, min(site) AS site FROM site_profiles WHERE lat IS NOT NULL GROUP BY lat)
SELECT p.version_id, f.site AS lat_site FROM site_profiles p JOIN first_site f USING (lat)""")
def join19_lat_lookup(spark: SparkSession, d: str) -> DataFrame:
    profiles = table(spark, d, "site_profiles").where("lat IS NOT NULL")
    return profiles.select("version_id", "lat").join(profiles.groupBy("lat").agg(F.min("site").alias("lat_site")), "lat").select("version_id", "lat_site")


# -- aggregates ---------------------------------------------------------------------------------


@query(f"WITH {WEEKLY} SELECT site, strftime(week, '%Y-%m-%d') AS week, strftime(week, '%G-%V') AS iso_week, da_raw FROM weekly")
def agg01_weekly_max(spark: SparkSession, d: str) -> DataFrame:
    return weekly(spark, d).select("site", iso("week").alias("week"), A.iso_week("week").alias("iso_week"), "da_raw")


@query(f"WITH {PN} SELECT site, strftime(date_trunc('week', date), '%Y-%m-%d') AS week, max(pn) AS pn FROM pn GROUP BY 1, 2")
def agg02_weekly_count_max(spark: SparkSession, d: str) -> DataFrame:
    return weekly_max(cell_counts(spark, d), "pn").select("site", iso("week").alias("week"), "pn")


@query(f"WITH {PN} SELECT strftime(date_trunc('month', date), '%Y-%m-%d') AS month, {q6('avg(pn)')} AS mean FROM pn GROUP BY 1")
def agg05_monthly_mean(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_by(cell_counts(spark, d).withColumn("month", iso(F.trunc("date", "month"))), ["month"], "pn", "mean")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{t}') + 1e-9, 6) AS sat_{t}_value" for t in _TYPES) + " FROM events GROUP BY 1, 2")
def agg07_pivot(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "value")
    wide = A.pivot_mean(daily, ["user_id", "day"], "event_type", "value", _TYPES, "sat_{}_value")
    return wide.select("user_id", iso("day").alias("day"), *[r6(f"sat_{t}_value") for t in _TYPES])


@query(f"WITH {PN} SELECT site, strftime(date_trunc('month', date), '%Y-%m-%d') AS month, arg_max(pn, (t, pn_id)) AS last_pn FROM pn GROUP BY 1, 2")
def agg08_last_in_month(spark: SparkSession, d: str) -> DataFrame:
    rows = cell_counts(spark, d).groupBy("site", iso(F.trunc("date", "month")).alias("month"))
    return rows.agg(F.max_by("pn", F.struct("t", "pn_id")).alias("last_pn"))


@query(f"WITH {SERIES} SELECT strftime(week, '%Y-%m-%d') AS week, count(da_raw) AS n, {q6('avg(da_raw)')} AS mean FROM series GROUP BY 1")
def agg12_mean_across_sites(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).groupBy(iso("week").alias("week")).agg(F.count("da_raw").alias("n"), r6(F.avg("da_raw"), "mean"))


@query(f"WITH m AS (SELECT {_CORR} FROM lineitem) SELECT string_split(pair, '|')[1] AS a, string_split(pair, '|')[2] AS b, r FROM (UNPIVOT m ON COLUMNS(*) INTO NAME pair VALUE r)")
def agg15_correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return A.correlation_matrix(table(spark, d, "lineitem").select(*_NUM)).select("a", "b", r6("r"))


@query("SELECT feature, r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)) + 1e-9, 6) AS r FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ") ORDER BY r DESC LIMIT 2")
def agg16_target_correlation(spark: SparkSession, d: str) -> DataFrame:
    return A.target_correlation(table(spark, d, "lineitem").select(*_NUM), "l_extendedprice", 2).select("feature", r6("r"))


@query(f"WITH {RAW} SELECT site, {q6('quantile_cont(da_raw, 0.05)')} AS q05, {q6('quantile_cont(da_raw, 0.5)')} AS q50, {q6('quantile_cont(da_raw, 0.95)')} AS q95 FROM raw GROUP BY site")
def agg17_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("da_raw", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return raw(spark, d).groupBy("site").agg(q.alias("q")).select("site", *[r6(F.col("q")[i], n) for i, n in enumerate(("q05", "q50", "q95"))])


@query(f"WITH {WEEKLY}, c AS (SELECT CASE WHEN da_raw <= 5 THEN 0 WHEN da_raw <= 20 THEN 1 WHEN da_raw <= 40 THEN 2 ELSE 3 END AS category FROM weekly), n AS (SELECT category, count(*) AS n FROM c GROUP BY 1) SELECT category, n, {q6('(SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n)')} AS weight FROM n")
def agg19_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return A.balanced_weights(weekly(spark, d).select(C.category_right_closed(F.col("da_raw")).alias("category")), "category").select("category", "n", r6("weight"))


def _maps(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "site_profiles").where("sampling_plan IS NOT NULL")
    per = rows.groupBy("site", "sampling_plan").agg(F.avg("spike_threshold").alias("g"))
    return per.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("sampling_plan", "g"))).alias("feature_importance"))


_PER = "per AS (SELECT site, sampling_plan AS feature, avg(spike_threshold) AS g FROM site_profiles WHERE sampling_plan IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_PER} SELECT feature, {q6('avg(g)')} AS mean_present, {q6('sum(coalesce(g, 0)) / (SELECT count(DISTINCT site) FROM per)')} AS mean_zero_filled FROM per GROUP BY feature")
def agg23_importance_means(spark: SparkSession, d: str) -> DataFrame:
    return A.map_means(_maps(spark, d), "feature_importance").select(F.col("key").alias("feature"), r6("mean_present"), r6("mean_zero_filled"))


@query(f"WITH {_PER} SELECT feature, site, {q6('g')} AS importance FROM per WHERE feature IN (SELECT feature FROM per GROUP BY feature ORDER BY avg(g) DESC, feature LIMIT 15)")
def agg25_importance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return A.map_matrix(_maps(spark, d), "site", "feature_importance", 15).select(F.col("key").alias("feature"), "site", r6("value", "importance"))


@query(f"WITH {WEEKLY} SELECT CASE WHEN site IN ('copalis', 'long beach') THEN 'north' ELSE 'south' END AS region, {q6('avg(da_raw)')} AS mean, count(*) AS n FROM weekly GROUP BY 1")
def agg27_regional_means(spark: SparkSession, d: str) -> DataFrame:
    region = F.when(F.col("site").isin("copalis", "long beach"), "north").otherwise("south")
    return weekly(spark, d).groupBy(region.alias("region")).agg(r6(F.avg("da_raw"), "mean"), F.count("*").alias("n"))


@query(f"WITH {RESULTS} SELECT DISTINCT ON (site, date) site, strftime(date, '%Y-%m-%d') AS date, response_id FROM results ORDER BY site, date, response_id")
def agg29_distinct_on(spark: SparkSession, d: str) -> DataFrame:
    firsts = results(spark, d).groupBy("site", "date").agg(F.min("response_id").alias("response_id"))
    return firsts.select("site", iso("date").alias("date"), "response_id")


@query(f"WITH {RESULTS} SELECT model, site, count(*) AS n, {q6('avg(abs(actual - naive_prediction))')} AS mae FROM results GROUP BY GROUPING SETS ((model), (model, site))")
def agg31_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d)
    mae = F.avg(F.abs(F.col("actual") - F.col("naive_prediction")))
    return rows.groupingSets([["model"], ["model", "site"]], "model", "site").agg(F.count("*").alias("n"), mae.alias("mae")).select("model", "site", "n", r6("mae"))


# -- ordering and sets ---------------------------------------------------------------------------


@query(f"WITH {RAW} SELECT sample_id, site, strftime(date, '%Y-%m-%d') AS date, da_raw FROM (SELECT * FROM raw ORDER BY t DESC, sample_id DESC LIMIT 1000)")
def sort02_recent(spark: SparkSession, d: str) -> DataFrame:
    recent = raw(spark, d).orderBy(F.desc("t"), F.desc("sample_id")).limit(1000)
    return recent.orderBy("t", "sample_id").select("sample_id", "site", iso("date").alias("date"), "da_raw")


@query(f"WITH {WEEKLY}, s AS (SELECT site, stddev_pop(da_raw) AS spread FROM weekly GROUP BY site) SELECT site, {q6('spread')} AS spread FROM s ORDER BY spread DESC, site LIMIT 10")
def sort03_top_k(spark: SparkSession, d: str) -> DataFrame:
    spread = weekly(spark, d).groupBy("site").agg(F.stddev_pop("da_raw").alias("spread"))
    return spread.orderBy(F.desc("spread"), "site").limit(10).select("site", r6("spread"))


@query(f"WITH {WEEKLY} SELECT site, strftime(arg_max(week, (da_raw, week)), '%Y-%m-%d') AS worst_week, strftime(arg_min(week, (da_raw, week)), '%Y-%m-%d') AS best_week FROM weekly GROUP BY site")
def sort05_arg_extremes(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("da_raw", "week")
    return weekly(spark, d).groupBy("site").agg(iso(F.max_by("week", order)).alias("worst_week"), iso(F.min_by("week", order)).alias("best_week"))


@query("SELECT DISTINCT lat FROM site_profiles WHERE lat IS NOT NULL")
def sort06_distinct_descending(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "site_profiles").select("lat").where("lat IS NOT NULL").distinct().orderBy(F.desc("lat"))


@query(f"WITH {RAW}, {PN} SELECT site, date::VARCHAR AS date, da_raw AS value, 'da' AS kind FROM raw UNION ALL SELECT site, date::VARCHAR, pn, 'pn' FROM pn")
def set01_union_all(spark: SparkSession, d: str) -> DataFrame:
    a = raw(spark, d).select("site", iso("date").alias("date"), F.col("da_raw").alias("value"), F.lit("da").alias("kind"))
    return a.unionByName(cell_counts(spark, d).select("site", iso("date").alias("date"), F.col("pn").alias("value"), F.lit("pn").alias("kind")))


@query(f"WITH {RAW}, {PN} SELECT site FROM raw UNION SELECT site FROM pn")
def set02_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("site").union(cell_counts(spark, d).select("site")).distinct()


# -- scalar functions ----------------------------------------------------------------------------


@query(f"""SELECT pn_id, {KEY} AS key, replace({KEY}, ' ', '-') AS slug FROM pn_counts""")
def fn01_site_names(spark: SparkSession, d: str) -> DataFrame:
    key = site_key(F.col("site"))
    return table(spark, d, "pn_counts").select("pn_id", key.alias("key"), F.replace(key, F.lit(" "), F.lit("-")).alias("slug"))


@query("""SELECT DISTINCT file_name, list_aggregate(list_transform(string_split(regexp_replace(regexp_replace(file_name, '\\.csv$', ''), '[-_](da|pn)$', ''), '-'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title FROM da_file_lines""")
def fn02_title_from_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "da_file_lines").select("file_name").distinct().withColumn("title", files.site_title(F.col("file_name")))


_PARTS = "string_split(trim(raw_line, chr(32) || chr(9) || chr(13)), ',')"
_NAMES = "['january','february','march','april','may','june','july','august','september','october','november','december']"


@query(f"""WITH parts AS (SELECT line_id, lower(trim({_PARTS}[1])) AS m, trim({_PARTS}[2]) AS d, trim({_PARTS}[3]) AS y FROM da_file_lines)
SELECT line_id, CASE WHEN list_position({_NAMES}, m) > 0 AND regexp_full_match(d, '[0-9]{{1,2}}') AND regexp_full_match(y, '[0-9]{{4}}')
THEN TRY_CAST(y || '-' || lpad(list_position({_NAMES}, m)::VARCHAR, 2, '0') || '-' || lpad(d, 2, '0') AS DATE)::VARCHAR END AS day FROM parts""")
def fn04_date_from_parts(spark: SparkSession, d: str) -> DataFrame:
    """Over all delivered lines, whatever they hold."""
    parts = F.split(F.trim("raw_line", F.lit(" \t\r")), ",")
    part = lambda n: F.get(parts, n)
    return table(spark, d, "da_file_lines").select("line_id", iso(files.date_from_parts(part(0), part(1), part(2))).alias("day"))


@query(f"""WITH dated AS (SELECT line_id, trim({_PARTS}[1]) AS x FROM da_file_lines)
SELECT line_id, CASE WHEN regexp_full_match(x, '[0-9]{{1,2}}/[0-9]{{1,2}}/([0-9]{{4}}|[0-9]{{2}})') THEN TRY_CAST((CASE WHEN length(string_split(x, '/')[3]) = 2 THEN '20' ELSE '' END)
|| string_split(x, '/')[3] || '-' || lpad(string_split(x, '/')[1], 2, '0') || '-' || lpad(string_split(x, '/')[2], 2, '0') AS DATE)::VARCHAR END AS day FROM dated""")
def fn05_lenient_dates(spark: SparkSession, d: str) -> DataFrame:
    """Over all delivered lines, whatever they hold."""
    first = F.get(F.split(F.trim("raw_line", F.lit(" \t\r")), ","), 0)
    return table(spark, d, "da_file_lines").select("line_id", iso(files.lenient_date(first)).alias("day"))


@query(f"""SELECT sample_id, CASE WHEN regexp_full_match(s, '(<[ \\t\\r]*)?[0-9]+(\\.[0-9]+)?') THEN (CASE WHEN starts_with(s, '<') THEN 0.5 ELSE 1.0 END) * CAST(regexp_extract(s, '[0-9]+(\\.[0-9]+)?') AS DOUBLE) END AS half
FROM (SELECT sample_id, trim(domoic_result, chr(32) || chr(9) || chr(13)) AS s FROM da_samples)""")
def fn07_censored_half(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "da_samples").select("sample_id", reading_value(F.col("domoic_result")).alias("half"))


@query(f"""SELECT sample_id, strftime(collect_date, '%G-%V') AS iso_week, strftime(date_trunc('week', collect_date), '%Y-%m-%d') AS monday, strftime(date_trunc('month', collect_date) - INTERVAL 2 MONTH, '%Y-%m-%d') AS two_months_back,
       strftime(collect_date, '%m/%d/%Y') AS us_date FROM da_samples WHERE collect_date IS NOT NULL""")
def fn08_calendar_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("collect_date")
    return table(spark, d, "da_samples").where("collect_date IS NOT NULL").select(
        "sample_id", A.iso_week("collect_date").alias("iso_week"), iso(monday(t)).alias("monday"), iso(month_shift(t, -2)).alias("two_months_back"),
        F.date_format(t, "MM/dd/yyyy").alias("us_date"),
    )


@query(f"WITH {WEEKLY} SELECT site, week::VARCHAR AS week, {q6('sin(2 * pi() * dayofyear(week) / 365)')} AS s, {q6('cos(2 * pi() * dayofyear(week) / 365)')} AS c, CAST(month(week) AS INTEGER) AS m, {q6('ln(1 + da_raw)')} AS log1, {q6('log10(da_raw + 1e-10)')} AS log10, {q6('sqrt(da_raw)')} AS root FROM weekly")
def fn12_calendar_and_maths(spark: SparkSession, d: str) -> DataFrame:
    from tidegrid.operators.windows import calendar_features

    rows = calendar_features(weekly(spark, d))
    return rows.select("site", iso("week").alias("week"), r6("sin_day_of_year", "s"), r6("cos_day_of_year", "c"), F.col("month").alias("m"),
                       r6(F.log1p("da_raw"), "log1"), r6(F.log10(F.col("da_raw") + 1e-10), "log10"), r6(F.sqrt("da_raw"), "root"))


@query(f"WITH {RAW} SELECT sample_id, CASE WHEN da_raw <= 5 THEN 0 WHEN da_raw <= 20 THEN 1 WHEN da_raw <= 40 THEN 2 ELSE 3 END AS right_closed, CASE WHEN da_raw < 5 THEN 0 WHEN da_raw < 20 THEN 1 WHEN da_raw < 40 THEN 2 ELSE 3 END AS left_closed, CASE WHEN da_raw < 5 THEN 'Low' WHEN da_raw < 20 THEN 'Moderate' WHEN da_raw < 40 THEN 'High' ELSE 'Extreme' END AS risk FROM raw")
def fn14_categories(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("da_raw")
    return raw(spark, d).select("sample_id", C.category_right_closed(x).alias("right_closed"), C.category_left_closed(x).alias("left_closed"), C.risk_label(x).alias("risk"))


@query(f"WITH {WEEKLY}, q AS (SELECT site, quantile_cont(da_raw, 0.95) AS q FROM weekly GROUP BY site) SELECT site, week::VARCHAR AS week, {q6('least(greatest(da_raw - 1, 0), q, 80)')} AS clipped FROM weekly JOIN q USING (site)")
def fn17_clip(spark: SparkSession, d: str) -> DataFrame:
    rows = weekly(spark, d)
    bounds = rows.groupBy("site").agg(F.percentile("da_raw", 0.95).alias("q"))
    return rows.join(bounds, "site").select("site", iso("week").alias("week"), r6(C.clipped(F.col("da_raw") - 1, F.col("q"), F.lit(80.0)), "clipped"))


@query(f"""SELECT response_id, {q6("CASE WHEN xgb_prediction IS NOT NULL AND rf_prediction IS NOT NULL THEN 0.56 * xgb_prediction + 0.44 * rf_prediction WHEN xgb_prediction IS NOT NULL THEN xgb_prediction ELSE rf_prediction END")} AS blended,
       CASE WHEN spike_probability IS NOT NULL OR prediction IS NOT NULL THEN coalesce(spike_probability >= 0.10, false) OR coalesce(prediction >= 12, false) END AS alert FROM forecast_responses""")
def fn18_blend_and_alert(spark: SparkSession, d: str) -> DataFrame:
    blended = C.blend((F.col("xgb_prediction"), F.lit(0.56)), (F.col("rf_prediction"), F.lit(0.44)), (F.col("naive_prediction"), F.lit(0.0)))
    return table(spark, d, "forecast_responses").select("response_id", r6(blended, "blended"), C.hybrid_alert(F.col("spike_probability"), F.col("prediction")).alias("alert"))


@query("SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE value END AS finite FROM events")
def fn21_json_numbers(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("value") > 200, float("inf")).when(F.col("value") > 100, float("nan")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", C.json_number(odd).alias("finite"))


@query(f"""WITH {WEEKLY}, m AS (SELECT site, min(least(da_raw, 80)) AS lo, max(least(da_raw, 80)) AS hi FROM weekly GROUP BY site)
SELECT site, week::VARCHAR AS week, {q6('CASE WHEN hi > lo THEN (least(da_raw, 80) - lo) / (hi - lo) ELSE 0 END')} AS scaled FROM weekly JOIN m USING (site)""")
def fn23_min_max_capped(spark: SparkSession, d: str) -> DataFrame:
    return A.min_max(weekly(spark, d), "da_raw", "site", cap=80.0).select("site", iso("week").alias("week"), r6("scaled"))


@query(f"WITH {WEEKLY}, l AS (SELECT {KEY} AS site, min(lat) AS lat FROM site_profiles WHERE lat IS NOT NULL GROUP BY 1) SELECT site, week::VARCHAR AS week, {q6('3 * lat + 0.01 * da_raw')} AS y FROM weekly JOIN l USING (site)")
def fn24_waterfall(spark: SparkSession, d: str) -> DataFrame:
    lats = table(spark, d, "site_profiles").where("lat IS NOT NULL").groupBy(site_key(F.col("site")).alias("site")).agg(F.min("lat").alias("lat"))
    return weekly(spark, d).join(lats, "site").select("site", iso("week").alias("week"), r6(3 * F.col("lat") + 0.01 * F.col("da_raw"), "y"))


#: Levels of the bars, the day of the middle one, the days between bars, and what every second row is moved by.
_BARS, _MIDDLE, _APART, _MOVED = (20, 50, 100), "2012-01-01", 120, 500


@query(f"""WITH lats AS (SELECT lat, row_number() OVER (ORDER BY lat DESC) - 1 AS i FROM (SELECT DISTINCT lat FROM site_profiles WHERE lat IS NOT NULL)),
bars AS (SELECT unnest([{', '.join(map(str, _BARS))}]) AS level, unnest([-{_APART}, 0, {_APART}]) AS away)
SELECT lat, level::INTEGER AS level, (DATE '{_MIDDLE}' + (away + CASE WHEN i % 2 = 1 THEN {_MOVED} ELSE 0 END)::INTEGER)::VARCHAR AS day, {q6('3 * lat')} AS base, {q6('3 * lat + 0.01 * level')} AS top FROM lats, bars""")
def fn24_reference_bars(spark: SparkSession, d: str) -> DataFrame:
    """Three bars of known height at each latitude of the waterfall, those of every second row moved aside."""
    lats = table(spark, d, "site_profiles").where("lat IS NOT NULL").select("lat").distinct()
    rows = lats.withColumn("i", F.row_number().over(Window.orderBy(F.desc("lat"))) - 1)
    bars = F.array(*[F.struct(F.lit(level).alias("level"), F.lit((n - 1) * _APART).alias("away")) for n, level in enumerate(_BARS)])
    each = rows.select("lat", "i", F.explode(bars).alias("b")).select("lat", "b.level", (F.col("b.away") + F.when(F.col("i") % 2 == 1, _MOVED).otherwise(0)).alias("away"))
    base = 3 * F.col("lat")
    return each.select("lat", "level", iso(F.date_add(F.lit(_MIDDLE).cast("date"), F.col("away"))).alias("day"), r6(base, "base"), r6(base + 0.01 * F.col("level"), "top"))


@query(f"""WITH b AS (SELECT response_id, prediction AS q50, prediction * 0.5 AS lo, prediction * 1.8 AS hi FROM forecast_responses WHERE prediction IS NOT NULL),
s AS (SELECT *, unnest(range(0, 30)) AS i FROM b), e AS (SELECT *, lo + (hi - lo) * (i + 0.5) / 30 AS mid, greatest(q50 - lo, hi - q50) AS far FROM s)
SELECT response_id, CAST(i AS INTEGER) AS segment, {q6('mid')} AS mid, {q6('least(greatest(1 - sqrt(abs(mid - q50) / far), 0.1), 0.9)')} AS opacity FROM e""")
def fn25_gradient_band(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("prediction")
    rows = table(spark, d, "forecast_responses").where("prediction IS NOT NULL").select("response_id", p.alias("q50"), (p * 0.5).alias("lo"), (p * 1.8).alias("hi"))
    return A.gradient_band(rows, 30).select("response_id", "segment", r6("mid"), r6("opacity"))


@query("SELECT response_id, list_transform([0, 1, 2, 3], lambda i: CASE WHEN i = predicted_category THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS slots FROM forecast_responses WHERE predicted_category IS NOT NULL")
def fn29_probability_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "forecast_responses").where("predicted_category IS NOT NULL")
    return rows.select("response_id", C.sparse_to_slots(F.create_map("predicted_category", F.lit(1.0))).alias("slots"))


@query(f"WITH {RAW} SELECT sample_id FROM (SELECT sample_id, row_number() OVER (PARTITION BY site ORDER BY md5(sample_id::VARCHAR || '|42'), sample_id) AS nth, ceil(count(*) OVER (PARTITION BY site) * CAST(0.2 AS DOUBLE)) AS take FROM raw) WHERE nth <= take")
def win10_site_sample(spark: SparkSession, d: str) -> DataFrame:
    return hashed_sample(raw(spark, d), group="site", key=["sample_id"], fraction=0.2, seed=42).select("sample_id")


