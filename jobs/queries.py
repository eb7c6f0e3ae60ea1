"""The jobs as queries: each runs twice into one new folder, and returns what stands there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumgrid.sources.tables import fresh_path

from . import evaluate_retrieval, index_new


def job1_index_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, out = fresh_path(spark, "job1"), None
    for _ in range(2):
        out = index_new.run(spark, f"{sf_dir}/documents.parquet", f"{base}/out", f"{base}/checkpoint")
    return out


def job2_evaluate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, out = fresh_path(spark, "job2"), None
    for _ in range(2):
        out = evaluate_retrieval.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", base)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_index_new, job2_evaluate_retrieval)}

INDEX_SQL = """
WITH d AS (
  SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(text) DESC NULLS LAST, source NULLS LAST, lang NULLS LAST) = 1
), t AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM d
), c AS (
  SELECT doc_id, term, count(*) AS n FROM t GROUP BY doc_id, term
), i AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, string_agg(term || ':' || n, ' ' ORDER BY term || ':' || n) AS terms FROM c GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN words IS NULL THEN 'failed' ELSE 'loaded' END AS status,
       CASE WHEN words > 0 THEN nullif(source, '') END AS ticker, CASE WHEN words > 0 THEN CAST(2024 + d.doc_id % 3 AS VARCHAR) END AS year,
       CASE WHEN words > 0 THEN lang END AS section, words, terms
FROM d LEFT JOIN i ON i.doc_id IS NOT DISTINCT FROM d.doc_id
"""

EVALUATION_SQL = r"""
WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
l AS (SELECT doc_id AS id, coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0) AS dl FROM documents),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
tf AS (SELECT term, id, count(*) AS f FROM t WHERE term IN (SELECT term FROM q) GROUP BY term, id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id, tf.id AS id, sum(greatest(0.000001, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
       FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (id), s GROUP BY item_id, tf.id),
found AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc QUALIFY rank <= 5),
holding AS (SELECT DISTINCT item_id, doc_id FROM documents d JOIN benchmark b ON trim(b.text) <> ''
  AND contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(b.text, '\s+', ' ', 'g')))),
got AS (SELECT f.item_id AS item_id, string_agg(CAST(f.id AS VARCHAR), ',' ORDER BY rank) AS retrieved, min(rank) FILTER (h.doc_id IS NOT NULL) AS first_rank, count(h.doc_id) AS n_hits
        FROM found f LEFT JOIN holding h ON h.item_id = f.item_id AND h.doc_id = f.id GROUP BY f.item_id),
nh AS (SELECT item_id, count(*) AS n_holding FROM holding GROUP BY item_id),
r AS (SELECT b.item_id AS item_id, coalesce(retrieved, '') AS retrieved, coalesce(n_holding, 0) AS n_holding, CAST(first_rank AS INTEGER) AS first_rank, first_rank IS NOT NULL AS quote_found,
        coalesce(n_holding, 0) > 0 AND coalesce(n_hits, 0) = least(n_holding, 5) AS hit_all,
        CASE WHEN n_holding IS NULL THEN 'no_answer' WHEN coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0) >= 20 THEN 'long' ELSE 'short' END AS kind
      FROM benchmark b LEFT JOIN got USING (item_id) LEFT JOIN nh USING (item_id)),
k AS (SELECT kind, count(*) AS of_kind, round(100.0 * avg(CAST(quote_found AS INTEGER)), 1) AS found_pct, round(100.0 * avg(CAST(hit_all AS INTEGER)), 1) AS all_pct, round(avg(coalesce(1 / first_rank, 0)), 3) AS reciprocal_rank
      FROM r WHERE kind <> 'no_answer' GROUP BY kind)
SELECT * FROM r LEFT JOIN k USING (kind)
"""

ORACLE_SQL: dict[str, str] = {"job1_index_new": INDEX_SQL, "job2_evaluate_retrieval": EVALUATION_SQL}
