"""Retrieval evaluation: asks the documents for every item of a question set and tells how often what comes back
holds the evidence.

    python -m jobs.evaluate_retrieval --documents IN --items IN --out OUT [--config jobs/evaluate_retrieval.json]

An item's text is both its question (its words, by BM25) and its evidence (the quote to be found).

* ``OUT/store``: the documents' terms, in partitions ticker, year;
* ``OUT/holding``: which document holds which item's quote, found once;
* ``OUT/results``: a row an item, in partitions kind: the documents that came back in their order, the first rank that
  holds the quote, whether one does (quote_found) and all documents that hold it do (hit_all, of k at most);
* ``OUT/rates``: JSON, a row a kind and one for all: questions, quote_found and hit_all in per cent, and the mean
  of 1 / first_rank.

Kinds: ``no_answer`` (no document holds the quote; counted, but not in the rates), else ``long`` (``long_words``
words or more) or ``short``.

Runs again safely: every table is overwritten with the same rows.

Defined cases: an item without a word asks nothing and gets nothing; null texts hold no quote; rows that
share an id are told apart by nothing and count once each; other columns are not looked at.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumgrid.functions.text import words
from vellumgrid.operators import evaluation, stored
from vellumgrid.sources.tables import read_config

log = logging.getLogger("evaluate_retrieval")

RESULTS = "item_id long, retrieved string, n_holding long, first_rank int, quote_found boolean, hit_all boolean, kind string"
RATES = "kind string, questions long, quote_found double, hit_all double, reciprocal_rank double"


def scored(items: DataFrame, found: DataFrame, holding: DataFrame, k: int, long_words: int) -> DataFrame:
    """``items(item_id, quote)``, ``found(item_id, doc_id, rank)`` and ``holding(doc_id, item_id)`` -> the results."""
    hits = found.join(holding.withColumn("holds", F.lit(True)), ["item_id", "doc_id"], "left")
    docs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda r: r["doc_id"].cast("string"))
    got = hits.groupBy("item_id").agg(F.array_join(docs, ",").alias("retrieved"), F.min(F.when(F.col("holds"), F.col("rank"))).alias("first_rank"), F.count("holds").alias("n_hits"))  # k rows an item
    n = holding.groupBy("item_id").agg(F.count("*").alias("n_holding"))
    rows = items.join(got, "item_id", "left").join(n, "item_id", "left").withColumn("n_holding", F.coalesce("n_holding", F.lit(0)))
    long = F.coalesce(F.size(words(F.col("quote"))), F.lit(0)) >= long_words
    kind = F.when(F.col("n_holding") == 0, "no_answer").when(long, "long").otherwise("short")
    every = (F.col("n_holding") > 0) & (F.coalesce("n_hits", F.lit(0)) == F.least("n_holding", F.lit(k)))
    return rows.select("item_id", F.coalesce("retrieved", F.lit("")).alias("retrieved"), F.col("n_holding").cast("long").alias("n_holding"), F.col("first_rank").cast("int").alias("first_rank"), F.col("first_rank").isNotNull().alias("quote_found"), every.alias("hit_all"), kind.alias("kind"))


def rates(results: DataFrame) -> DataFrame:
    """Of the answerable items, by kind and overall (kind ``all``)."""
    rows = results.where("kind <> 'no_answer'").withColumn("back", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))
    told = evaluation.rates(rows, "kind", ["quote_found", "hit_all"])
    mean = rows.rollup("kind").agg(F.round(F.avg("back"), 3).alias("reciprocal_rank"))
    all_ = F.coalesce("kind", F.lit("all")).alias("kind")
    return told.select(all_, "questions", "quote_found", "hit_all").join(mean.select(all_, "reciprocal_rank"), "kind")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The results with the rates of their kinds."""
    results, by = spark.read.schema(RESULTS).parquet(f"{out}/results"), spark.read.schema(RATES).json(f"{out}/rates")
    return results.join(by.select("kind", F.col("questions").alias("of_kind"), F.col("quote_found").alias("found_pct"), F.col("hit_all").alias("all_pct"), "reciprocal_rank"), "kind", "left")


def run(spark: SparkSession, documents: str, items: str, out: str, k: int = 5, long_words: int = 20) -> DataFrame:
    """Evaluate, write, and return :func:`current`."""
    year = (F.pmod("doc_id", F.lit(3)) + 2024).cast("string")
    docs = spark.read.parquet(documents).select(F.col("doc_id").alias("id"), F.col("source").alias("ticker"), year.alias("year"), F.col("lang").alias("section"), "text")
    asked = spark.read.parquet(items).select("item_id", F.col("text").alias("quote"))
    made = stored.rows(docs)
    made.drop("text").write.mode("overwrite").partitionBy("ticker", "year").parquet(f"{out}/store")
    store = stored.read(spark, f"{out}/store", made.drop("text"))
    log.info("read %d documents and %d items, wrote %s/store", store.count(), asked.count(), out)
    phrases = F.transform(words(F.coalesce("quote", F.lit(""))), lambda w: F.array(w))
    found = stored.lists(store, asked.select(F.col("item_id").alias("ask"), phrases.alias("phrases")), dense=0, keyword=k)
    found = found.select(F.col("ask").alias("item_id"), F.col("id").alias("doc_id"), "rank")
    said = asked.where(F.length(F.trim("quote")) > 0)
    holding = evaluation.quoted(docs.select(F.col("id").alias("doc_id"), "text"), said)
    holding.write.mode("overwrite").parquet(f"{out}/holding")
    holding = spark.read.schema(holding.schema).parquet(f"{out}/holding")  # it is asked twice
    scored(asked, found, holding, k, long_words).write.mode("overwrite").partitionBy("kind").parquet(f"{out}/results")
    results = spark.read.schema(RESULTS).parquet(f"{out}/results")
    rates(results).coalesce(1).write.mode("overwrite").json(f"{out}/rates")  # a row a kind
    for r in spark.read.schema(RATES).json(f"{out}/rates").collect():
        log.info("%s: %d questions, quote found %.1f %%, all %.1f %%, mean reciprocal rank %.3f", r["kind"], r["questions"], r["quote_found"], r["hit_all"], r["reciprocal_rank"])
    return current(spark, out)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "items", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    told = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("evaluate_retrieval").getOrCreate()
    try:
        settings = read_config(spark, told.config) if told.config else {}
        log.info("wrote %d results to %s", run(spark, told.documents, told.items, told.out, **settings).count(), told.out)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
