"""Batched hybrid retrieval: a table of questions in, ranked chunks out, in one plan.

A question about several companies becomes one ask a company with its own quota.  Company
names are taken out of the keyword words, and the names of the question's other companies out of what is
embedded.  Filters restrict both lists before their candidates are cut; ids are fused and
cut before texts join.  Questions are asked of a store (:mod:`..operators.stored`), in blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CANDIDATES, PER_COMPANY, TOP_K
from ..functions.models import embedded
from ..functions.text import dot_distance
from ..operators import ranking, stored, understand


def asks(questions: DataFrame, chunks: DataFrame, aliases: dict[str, list[str]], order: list[str], k: int = TOP_K) -> DataFrame:
    """``questions(qid, question[, tickers, years, sections])`` -> one row for each
    question and company: ask, qid, place, ticker, years, sections, n, question, keywords."""
    loaded = F.broadcast(chunks.select("year").distinct().agg(F.array_sort(F.collect_set("year")).alias("loaded")))
    rows = understand.filters(questions.join(loaded), aliases, order, F.col("loaded"))
    several = F.size("tickers") > 1
    none = F.array(F.lit(None).cast("string"))
    rows = rows.select("qid", "question", "years", "sections", F.when(several, ranking.quota(k, F.size("tickers"))).otherwise(k).alias("n"), several.alias("several"), F.col("tickers").alias("all"), F.posexplode(F.when(F.size("tickers") > 0, F.col("tickers")).otherwise(none)).alias("place", "ticker"))
    latest = chunks.groupBy("ticker").agg(F.max("year").alias("last"))
    rows = rows.join(latest, "ticker", "left")
    years = F.when(F.array_contains("years", "latest"), F.array(F.coalesce("last", F.lit("")))).otherwise(F.col("years"))
    own = F.array_compact(F.array("ticker"))
    rows = rows.withColumn("others", understand.without_companies(F.col("question"), aliases, F.array_except("all", own)))
    keyword = understand.without_companies(F.col("others"), aliases, own)
    return rows.select(F.concat_ws("#", "qid", "place").alias("ask"), "qid", "place", "ticker", years.alias("years"), "sections", "n", F.col("others").alias("question"), keyword.alias("keywords"))


def retrieve(questions: DataFrame, store: DataFrame, aliases: dict[str, list[str]], order: list[str], k: int = TOP_K, mode: str = "hybrid") -> DataFrame:
    """``store``: rows as of :mod:`..operators.stored`, with id, ticker, year, section -> qid, rank, distance (of the
    question's and the chunk's vector, null where one of them has no words), score (hybrid only), and the
    chunk's columns.  A question without words has no dense list; one that nothing answers has no row."""
    chunks = store.drop("terms", "counts", "positions")
    phrases = F.transform(understand.keyword_words(F.col("keywords")), lambda w: F.regexp_extract_all(w, F.lit("[a-z0-9]+"), F.lit(0)))
    rows = asks(questions, chunks, aliases, order, k).withColumns({"phrases": phrases, "q": embedded(F.col("question"))}).persist()  # a row a question and company
    own = rows if mode == "hybrid" else rows.withColumn("phrases", F.array().cast("array<array<string>>"))
    most = max(CANDIDATES, k, PER_COMPANY)
    found = stored.lists(store, own, dense=most).withColumnRenamed("ask", "qid")
    if mode == "dense":
        best, key = found.where("dense").select("qid", "id", "rank", "value"), F.col("value")
    else:
        best, key = ranking.fuse(found.where(F.col("dense") & (F.col("rank") <= CANDIDATES)), found.where(~F.col("dense")), 2 * CANDIDATES), -F.col("score")
    best = best.withColumnRenamed("qid", "ask").withColumnRenamed("rank", "inner").join(F.broadcast(rows.select("ask", "qid", "place", "n", "q")), "ask").where(F.col("inner") <= F.col("n"))
    merged = Window.partitionBy("qid").orderBy(key, "place", "inner")
    ranked = best.withColumn("rank", F.row_number().over(merged)).drop("ask", "place", "inner", "n", "value")
    return ranking.materialise(ranked, chunks).withColumn("distance", dot_distance(F.col("q"), F.col("v"))).drop("q", "v")
