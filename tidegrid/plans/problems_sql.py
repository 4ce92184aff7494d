"""The same results as ``problems`` in SQL, written independently of the operators."""

_BL = "chr(32) || chr(9) || chr(13)"
_KEY = f"lower(translate(trim({{0}}, {_BL}), '-_', '  '))"
_NUM = r"(<[ \t\r]*)?[0-9]+(\.[0-9]+)?"
_USABLE = f"""
usable AS (
  SELECT {_KEY.format('site')} AS k, site, collect_date AS t, sample_id,
         CASE WHEN starts_with(s, '<') THEN 0.5 ELSE 1.0 END * CAST(regexp_extract(s, '[0-9]+(\\.[0-9]+)?') AS DOUBLE) AS x
  FROM (SELECT *, trim(domoic_result, {_BL}) AS s FROM da_samples)
  WHERE site IS NOT NULL AND collect_date IS NOT NULL AND regexp_full_match(s, '{_NUM}')
)"""

_FIELD = r'[ \t\r]*(?:"((?:[^"]|"")*)"|([^",]*))[ \t\r]*'
_PLAIN = r'(?:[ \t\r]*"(?:[^"]|"")*"[ \t\r]*|[^",]*)'
_RESULT = r"(<[ \t\r]*)?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?"
_MONTHS = "['january','february','march','april','may','june','july','august','september','october','november','december']"


def _field(n: int, of: int) -> str:
    pattern = "^" + ",".join([_FIELD] * of) + "$"
    return f"trim(replace(regexp_extract(r, '{pattern}', {2 * n - 1}) || regexp_extract(r, '{pattern}', {2 * n}), '\"\"', '\"'), {_BL})"


_LINES = f"""
heads AS (
  SELECT delivery_id, len(string_split(raw_line, ',')) AS width FROM da_file_lines WHERE line_no = 1
), body AS (
  SELECT line_id, width, trim(raw_line, {_BL}) AS r FROM da_file_lines JOIN heads USING (delivery_id)
  WHERE line_no > 1 AND trim(raw_line, {_BL}) <> ''
), shaped AS (
  SELECT *, NOT regexp_full_match(r, '{_PLAIN}(?:,{_PLAIN})*') AS bad_quotes,
         len(string_split(regexp_replace(r, '"(?:[^"]|"")*"', '', 'g'), ',')) AS n
  FROM body
), fields AS (
  SELECT line_id, width, CASE WHEN bad_quotes THEN 'quoting' WHEN n <> width THEN 'columns' END AS broken,
         CASE WHEN width = 2 THEN {_field(1, 2)} ELSE {_field(1, 4)} END AS f1,
         CASE WHEN width = 2 THEN {_field(2, 2)} ELSE {_field(2, 4)} END AS f2,
         {_field(3, 4)} AS f3, {_field(4, 4)} AS f4
  FROM shaped
), dated AS (
  SELECT line_id, broken, CASE WHEN width = 2 THEN f2 ELSE f4 END AS result,
         CASE WHEN width = 2 AND regexp_full_match(f1, '[0-9]{{1,2}}/[0-9]{{1,2}}/([0-9]{{4}}|[0-9]{{2}})')
                THEN TRY_CAST((CASE WHEN length(string_split(f1, '/')[3]) = 2 THEN '20' ELSE '' END) || string_split(f1, '/')[3]
                     || '-' || lpad(string_split(f1, '/')[1], 2, '0') || '-' || lpad(string_split(f1, '/')[2], 2, '0') AS DATE)
              WHEN width = 4 AND list_position({_MONTHS}, lower(f1)) > 0 AND regexp_full_match(f2, '[0-9]{{1,2}}') AND regexp_full_match(f3, '[0-9]{{4}}')
                THEN TRY_CAST(f3 || '-' || lpad(CAST(list_position({_MONTHS}, lower(f1)) AS VARCHAR), 2, '0') || '-' || lpad(f2, 2, '0') AS DATE)
         END AS day
  FROM fields
), judged AS (
  SELECT line_id, day, result, COALESCE(broken, CASE WHEN day IS NULL OR NOT (result = '' OR regexp_full_match(result, '{_RESULT}')) THEN 'values' END) AS reason
  FROM dated
)"""

_WEEKS = """
one AS (SELECT k, t, max(x) AS x FROM usable GROUP BY k, t),
pairs AS (
  SELECT k, t, x, lead(t) OVER (PARTITION BY k ORDER BY t) AS t1, lead(x) OVER (PARTITION BY k ORDER BY t) AS x1 FROM one
),
spans AS (SELECT k, date_trunc('week', min(t)) AS w0, date_trunc('week', max(t)) AS w1 FROM one GROUP BY k),
weeks AS (SELECT k, CAST(unnest(generate_series(CAST(w0 AS TIMESTAMP), CAST(w1 AS TIMESTAMP), INTERVAL 7 DAY)) AS TIMESTAMP) AS w FROM spans),
counted AS (SELECT k, CAST(date_trunc('week', t) AS TIMESTAMP) AS w, count(*) AS readings FROM one GROUP BY 1, 2)"""


def _pieces(increment: str, limit: str) -> str:
    return f"""
cut AS (
  SELECT k, CAST(unnest(generate_series(CAST(date_trunc('week', t) AS TIMESTAMP), CAST(date_trunc('week', t1) AS TIMESTAMP), INTERVAL 7 DAY)) AS TIMESTAMP) AS w,
         t, t1, x, x1, epoch_us(t1) - epoch_us(t) AS gap, {increment} AS inc
  FROM pairs WHERE t1 IS NOT NULL {limit}
), shares AS (
  SELECT k, w, sum(inc * ov / gap) AS increment, sum(ov) AS covered, count(*) FILTER (WHERE x1 < x AND w = CAST(date_trunc('week', t1) AS TIMESTAMP)) AS resets
  FROM (SELECT *, greatest(0, least(epoch_us(t1), epoch_us(w) + 604800000000) - greatest(epoch_us(t), epoch_us(w))) AS ov FROM cut)
  GROUP BY k, w
), gridded AS (
  SELECT k, w, COALESCE(readings, 0) AS readings, COALESCE(increment, 0) AS increment, COALESCE(covered, 0) AS covered, COALESCE(resets, 0) AS resets,
         CASE WHEN readings > 0 THEN 'observed' WHEN covered = 604800000000 THEN 'filled' ELSE 'missing' END AS status
  FROM weeks LEFT JOIN counted USING (k, w) LEFT JOIN shares USING (k, w)
)"""


_LEVEL = _pieces("x * (epoch_us(t1) - epoch_us(t)) / 86400000000.0", "AND epoch_us(t1) - epoch_us(t) <= 28 * 86400000000")
_COUNTER = _pieces("CASE WHEN x1 >= x THEN x1 - x ELSE x1 END", "")

_KNOWN = f"""
events_ AS (
  SELECT r.response_id, {_KEY.format('r.site')} AS k, COALESCE(r.forecast_date, q.req_date) AS d
  FROM forecast_responses r LEFT JOIN forecast_requests q ON r.forecast_date IS NULL AND r.request_id = q.request_id
), held AS (
  SELECT e.response_id, e.d, p.*, row_number() OVER (PARTITION BY e.response_id ORDER BY p.valid_from DESC, p.known_at DESC, p.version_id DESC) AS nth
  FROM events_ e JOIN site_profiles p ON {_KEY.format('p.site')} = e.k AND p.valid_from <= e.d AND p.known_at <= CAST(e.d AS TIMESTAMP)
)"""

_TRAIL = ", ".join(
    f"sum(n) OVER w{d} AS n_{d}d, sum(total) OVER w{d} AS total_{d}d" for d in (7, 30)
)
_TRAILED = ", ".join(
    f"n_{d}d, round(total_{d}d + 1e-9, 6) AS total_{d}d, round(CASE WHEN n_{d}d > 0 THEN total_{d}d / n_{d}d END + 1e-9, 6) AS avg_{d}d, round(total_{d}d / {d} + 1e-9, 6) AS daily_avg_{d}d"
    for d in (7, 30)
)

ORACLES = {
    "p1_found": f"WITH {_LINES} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_measurements": f"""WITH {_LINES}
SELECT line_id, CAST(day AS VARCHAR) AS measured_on, TRY_CAST(replace(regexp_replace(result, '^<[ \\t\\r]*', ''), ',', '') AS DOUBLE) AS result,
       CASE WHEN result <> '' THEN starts_with(result, '<') END AS below_limit
FROM judged WHERE reason IS NULL""",
    "p2_trailing": f"""WITH {_USABLE}, daily AS (
  SELECT k, CAST(t AS DATE) AS day, count(*) AS n, sum(x) AS total FROM (SELECT DISTINCT k, t, x FROM usable) GROUP BY 1, 2
), cal AS (
  SELECT k, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY k
), dense AS (
  SELECT k, day, COALESCE(n, 0) AS n, COALESCE(total, 0.0) AS total FROM cal LEFT JOIN daily USING (k, day)
), rolled AS (
  SELECT *, {_TRAIL} FROM dense
  WINDOW w7 AS (PARTITION BY k ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY k ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
)
SELECT k AS site, CAST(day AS VARCHAR) AS day, n, round(total + 1e-9, 6) AS total, {_TRAILED} FROM rolled""",
    "p3_found": f"""WITH {_USABLE}, {_WEEKS}
SELECT site, strftime(w, '%Y-%m-%d') AS week_start FROM weeks ANTI JOIN counted USING (k, w)
JOIN (SELECT k, min(site) AS site FROM usable GROUP BY k) USING (k)""",
    "p3_grid": f"""WITH {_USABLE}, {_WEEKS}, {_LEVEL}
SELECT k AS site, strftime(w, '%Y-%m-%d') AS week_start, readings, round(increment + 1e-9, 6) AS increment, round(covered / 604800000000.0 + 1e-9, 6) AS covered_share,
       round(CASE WHEN covered > 0 THEN increment / (covered / 86400000000.0) END + 1e-9, 6) AS rate, status FROM gridded""",
    "p3_counter": f"""WITH {_USABLE}, {_WEEKS}, {_COUNTER}
SELECT k AS site, strftime(w, '%Y-%m-%d') AS week_start, readings, round(increment + 1e-9, 6) AS increment, resets, status FROM gridded""",
    "p4_found": f"WITH {_KNOWN} SELECT response_id, version_id FROM held WHERE nth = 1",
    "p4_attributes": f"""WITH {_KNOWN}
SELECT response_id, CAST(d AS VARCHAR) AS event_date, spike_threshold, horizon_weeks, sampling_plan FROM held WHERE nth = 1""",
}
