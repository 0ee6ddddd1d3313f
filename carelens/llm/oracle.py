"""DuckDB SQL for the registered queries that SQL can express."""

from . import quality_rules as Q

_GAP = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"

LINE_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^{_GAP}+|{_GAP}+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key != '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


def quality_rules() -> str:
    metrics = " UNION ALL ".join(
        f"SELECT r, lang, source, '{m}' AS metric, CAST({e.replace(' div ', ' // ')} AS BIGINT) AS v FROM s WHERE NOT base_failed"
        for m, (e, _, _) in Q.METRICS.items())
    spread = "CASE metric " + " ".join(f"WHEN '{m}' THEN {s}" for m, (_, s, _) in Q.METRICS.items()) + " END"
    low = "metric IN (" + ", ".join(f"'{m}'" for m, (_, _, both) in Q.METRICS.items() if both) + ")"
    order = "CASE metric " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(Q.METRICS)) + " END"
    level = lambda k, lang, source: (
        f"SELECT {k} AS level, {lang} AS lang, {source} AS source, metric, cell, count(*) AS n FROM c GROUP BY ALL")
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '{_WORD}+') AS w,
             list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '{_WORD}')) AS l FROM t),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM n WHERE n > 1) GROUP BY r),
b AS (SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
             CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.r = cov.r),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
v AS ({metrics}),
c AS (SELECT *, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS cell FROM v),
z AS ({level(2, 'lang', 'source')} UNION ALL {level(1, 'lang', 'CAST(NULL AS VARCHAR)')}
      UNION ALL {level(0, 'CAST(NULL AS VARCHAR)', 'CAST(NULL AS VARCHAR)')}),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric) AS rows_,
             sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY cell) AS upto FROM z),
q AS (SELECT level, lang, source, metric, rows_, min(cell) FILTER (WHERE 4 * upto >= rows_) AS q1,
             min(cell) FILTER (WHERE 4 * upto >= 3 * rows_) AS q3 FROM u GROUP BY ALL),
f AS (SELECT *, CASE WHEN {low} THEN q1 - {Q.FENCE} * greatest(q3 - q1, {spread}) END AS lo,
             q3 + {Q.FENCE} * greatest(q3 - q1, {spread}) AS hi FROM q),
j AS (SELECT v.r, v.metric, v.v, first(f.lo ORDER BY f.level DESC) AS lo, first(f.hi ORDER BY f.level DESC) AS hi
      FROM v JOIN f ON f.metric = v.metric AND (f.level = 0 OR f.rows_ >= {Q.MIN_ROWS} AND f.lang IS NOT DISTINCT FROM v.lang
                                                AND (f.level = 1 OR f.source IS NOT DISTINCT FROM v.source))
      GROUP BY v.r, v.metric, v.v),
bad AS (SELECT r, string_agg(metric, ',' ORDER BY {order}) AS rules FROM j WHERE v > hi OR v < lo GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND bad.r IS NULL AS kept, CASE WHEN base_failed THEN 'base' ELSE coalesce(bad.rules, '') END AS failed_rules
FROM s LEFT JOIN bad ON s.r = bad.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules(), "op6_line_dedup": LINE_DEDUP}
