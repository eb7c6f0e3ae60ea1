"""DuckDB SQL for the rows of the licence scan, built from the same signatures."""

from __future__ import annotations

from .license_rules import BASE, rules, spaced


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_ROWS = [(0, label, spaced(p), spaced(p)) for p, label in BASE] + rules()
_VALUES = ",\n".join(f"({o}, {_text(lab)}, {_text(k)}, {_text(x)})" for o, lab, k, x in _ROWS)

LICENSES_SQL = f"""
WITH signatures(ord, label, keyword, rx) AS (VALUES {_VALUES}),
d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') AS words
  FROM documents
),
t AS (SELECT rid, ' ' || array_to_string(words, '  ') || ' ' AS txt FROM d),
m AS (
  SELECT rid, ord, label, string_split_regex(txt, rx) AS gaps, regexp_extract_all(txt, rx) AS hits
  FROM t JOIN signatures ON contains(txt, keyword)
),
c AS (
  SELECT rid, ord, label,
         list_transform(gaps, lambda g: (length(g) - length(replace(g, ' ', ''))) // 2) AS g,
         list_transform(hits, lambda h: (length(h) - length(replace(h, ' ', ''))) // 2) AS h
  FROM m WHERE len(hits) > 0
),
s AS (
  SELECT rid, ord, label, unnest(list_transform(range(1, len(h) + 1), lambda i: {{
    'a': CAST(list_sum(g[1:i]) + coalesce(list_sum(h[1:i - 1]), 0) AS BIGINT),
    'b': CAST(list_sum(g[1:i]) + list_sum(h[1:i]) AS BIGINT)}})) AS p
  FROM c
),
f AS (SELECT rid, ord, label, p.a AS a, p.b AS b FROM s),
kept AS (
  SELECT rid, ord, label FROM f m WHERE ord > 0 AND NOT EXISTS (
    SELECT 1 FROM f o WHERE o.rid = m.rid AND o.ord > 0 AND o.a <= m.a AND o.b >= m.b
      AND (o.b - o.a > m.b - m.a OR o.ord < m.ord))
),
base AS (
  SELECT rid, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels
  FROM f WHERE ord = 0 GROUP BY rid
),
every AS (
  SELECT rid, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
  FROM (SELECT rid, label FROM f WHERE ord = 0 UNION ALL SELECT rid, label FROM kept) GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) WHEN labels IS NOT NULL THEN CAST(0.75 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN every USING (rid)
"""
