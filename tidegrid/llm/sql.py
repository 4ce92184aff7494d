"""SQL for the llm queries that SQL can express on whole tables; the others have brute-force tests."""

from tidegrid.plans.problems_sql import _KEY, _USABLE

_NEAREST = f"""{_USABLE}, counts AS (
  SELECT pn_id, {_KEY.format('site')} AS k, sampled_at AS t, pn_count FROM pn_counts WHERE site IS NOT NULL AND sampled_at IS NOT NULL
), ranked AS (
  SELECT c.pn_id, c.pn_count, u.sample_id, u.x, abs(epoch_us(u.t) - epoch_us(c.t)) AS gap,
         row_number() OVER (PARTITION BY c.pn_id ORDER BY abs(epoch_us(u.t) - epoch_us(c.t)), u.t, u.sample_id) AS nth
  FROM counts c JOIN usable u ON u.k = c.k AND u.t >= c.t - INTERVAL 24 HOUR AND u.t <= c.t + INTERVAL 24 HOUR
)"""

_PLAIN_COUNT = "trim(pn_count, chr(32) || chr(9) || chr(13))"

_WINDOWS = """
SELECT {id} AS id, list_slice(w, i, i + 11) AS twelve FROM (
  SELECT {id}, w, unnest(range(1, len(w) - 10)) AS i FROM (
    SELECT {id}, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM {table} WHERE text IS NOT NULL
  ) WHERE len(w) >= 12
)"""

_STRETCHES = """
stretches AS (
  SELECT doc_id, i, md5_number(substring(text, i, 300)) AS h FROM (
    SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300
  )
), common AS (SELECT h FROM stretches GROUP BY h HAVING min(doc_id) <> max(doc_id)),
held AS (SELECT doc_id, i, h FROM stretches SEMI JOIN common USING (h))"""

ORACLES = {
    "p5_found": f"WITH {_NEAREST} SELECT pn_id, sample_id FROM ranked WHERE nth = 1",
    "p5_paired": f"""WITH {_NEAREST}
SELECT pn_id, sample_id, round(gap / 3600000000.0 + 1e-9, 6) AS gap_hours,
       CASE WHEN regexp_full_match({_PLAIN_COUNT}, '([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\\.[0-9]+)?') THEN CAST(replace({_PLAIN_COUNT}, ',', '') AS DOUBLE) END AS cells, x AS result
FROM ranked WHERE nth = 1""",
    "p7_found": f"""WITH i AS ({_WINDOWS.format(id='item_id', table='eval_items')}), d AS ({_WINDOWS.format(id='doc_id', table='documents')})
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM d JOIN i ON d.twelve = i.twelve""",
    "p8_found": f"""WITH {_STRETCHES}
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM held a JOIN held b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p8_shared": f"""WITH {_STRETCHES}, news AS (
  SELECT doc_id, least(300, COALESCE(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 300)) AS new FROM held
), sums AS (SELECT doc_id, sum(new) AS shared_chars FROM news GROUP BY doc_id),
classes AS (SELECT text, min(doc_id) AS class_id FROM documents WHERE length(text) >= 300 GROUP BY text)
SELECT doc_id, COALESCE(length(text), 0) AS n_chars, COALESCE(shared_chars, 0) AS shared_chars,
       round(CASE WHEN length(text) > 0 THEN COALESCE(shared_chars, 0) / length(text) ELSE 0 END + 1e-9, 6) AS shared_share,
       COALESCE(class_id, doc_id) AS class_id
FROM documents LEFT JOIN sums USING (doc_id) LEFT JOIN classes USING (text)""",
}
