"""Training-corpus pipeline over ``documents``, in stages that each call one operator.

1 language ID: documents without a recognisable language go;
2 quality: documents that the learned classifier scores below its threshold go;
3 SimHash near-dedup: of each group of exact or near copies the smallest doc_id stays;
4 decontamination: documents into which a benchmark item leaks go;
5 byte-level BPE: adds token counts and digests.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given.  Models are
learned from the bounded samples that their operators document: the language model from
all of ``docs``, the quality model from the rows of ``docs`` that ``labels`` covers.

Defined cases, for all stages: any column of ``docs`` may be null; rows with a null doc_id are
never removed as copies or leaks, as nothing names them; repeated rows are kept or removed
together, but for stage 3, to which rows with one doc_id are one document; an empty table stays
empty; extra columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.llm import bpe, decontaminate, langid, quality, simhash
from vellumgrid.llm.common import fresh, remove, shared_dir, table, without
from vellumgrid.llm.queries import GOOD, _pattern, _vocabulary

#: Probability that the predicted language must have.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a predicted language that has at least the probability ``SURE``.  Null
    and empty texts and those without a letter go, and so do all if no row has a lang to learn from."""
    predict, p = langid.predictor(spark, langid.fit(docs.select("doc_id", "text", "lang"))), fresh(docs, "p")
    return docs.withColumn(p, predict("text")).where((F.col(f"{p}.lang_pred") != langid.UNKNOWN) & (F.col(f"{p}.score") >= SURE)).select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of score ``GOOD`` or more.  Null texts count as empty; without any label
    nothing is known and all documents stay."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    model, p = quality.fit(docs, labels), fresh(docs, "p")
    if not model.learned():
        return docs
    return docs.withColumn(p, quality.scorer(spark, model)("text")).where(F.col(p) >= GOOD).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of exact and near copies (five-word shingles, a
    similarity of 0.8 or more).  Null and empty texts are copies of each other."""
    return without(docs, "doc_id", simhash.copies(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents into which no benchmark item leaks; null and empty texts hold none."""
    return without(docs, "doc_id", decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256, in place of columns of these names; null
    texts count as empty."""
    p = fresh(docs, "p")
    coded = docs.withColumn(p, bpe.digests(F.col("text"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern()))
    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    return coded.select(*[c for c in docs.columns if c.lower() not in made], *[F.col(f"{p}.{c}").alias(c) for c in made])


STAGES = [
    ("language_id", language_id),
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: No stage but the last can be told in SQL (learned models, sketches).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written as Parquet and read again.  A stage's folder is
    deleted once the next one is written, but for the last, which the result is read from."""
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}/{k}-{name}"
        out.write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
