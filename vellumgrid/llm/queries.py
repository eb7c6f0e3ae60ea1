"""The contract queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunk_bpe, collocations, decontaminate, langid, licenses, pfor, pivots, quality, simhash, suffix_tree, toxicity
from .common import fold, table
from .licenses_sql import LICENSES_SQL

#: Score from which a text counts as good.
GOOD = 0.7


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~fold(F.col("doc_id"), 4, 2)))
    out = docs.select("doc_id", fold(F.col("doc_id"), 4, 2).alias("held_out"), langid.predictor(spark, model)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, kept = F.col("licences.base"), F.col("licences.kept")
    names = lambda x: F.array_join(F.sort_array(F.array_distinct(F.transform(x, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    score = F.when(F.size(base) > 0, 1.0).when(F.size(kept) > 0, 0.75).otherwise(0.0)
    return found.select("doc_id", F.col("licences.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.concat(base, kept)).alias("labels"), score.alias("score"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", fold(F.col("doc_id"), 7, 2).alias("held_out"), "text")
    return suffix_tree.score(docs, suffix_tree.fit(docs.where(~F.col("held_out"))))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pfor.checksums(pfor.write(docs, pfor.fresh_path(spark, "tokens"), _vocabulary("byte_bpe_50k.json")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", bpe.digests(F.col("text"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern()).alias("p"))
    return out.select("doc_id", "p.n_tokens", "p.ids_sha256", "p.decoded_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels of the rows whose crc32(doc_id as text) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")).where(~fold(F.col("doc_id"), 4, 2))
    model = toxicity.fit(docs, labels)
    out = docs.select("doc_id", fold(F.col("doc_id"), 4, 2).alias("held_out"), toxicity.scorer(spark, model)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.severity", "p.grade", "p.score", (F.col("p.score") >= 0.5).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).where(~fold(F.col("doc_id"), 4, 2))
    model = quality.fit(docs, labels)
    out = docs.select("doc_id", fold(F.col("doc_id"), 4, 2).alias("held_out"), quality.scorer(spark, model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op9_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivots.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return pivots.top_k(vectors, F.col("id") % 50 == 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    found = collocations.mine(table(spark, sf_dir, "documents"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, chunks that several share once."""
    return chunk_bpe.digests(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_license_scan, op3_suffix_tree, op4_token_files, op5_byte_bpe, op6_toxicity, op7_decontamination, op8_quality, op9_pivot_search, op10_simhash, op11_collocations, op12_chunk_bpe)
}

PIVOT_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id AND len(q.x) = len(c.x)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op2_license_scan": LICENSES_SQL, "op9_pivot_search": PIVOT_SQL, "op11_collocations": collocations.COLLOCATIONS_SQL}
