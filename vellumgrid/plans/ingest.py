"""Composed ingest: filings wanted in, sections and a retrieval store written, a status a filing out.

Pages become sections, sections chunks, chunks store rows (terms and vectors) in one plan a table:

* ``PATH/sections``: ticker, year, item, text, error; what a filing's page was read as;
* ``PATH/store``: the chunks, as of :mod:`..operators.stored`.

Both are dealt out by filing to a fixed number of folders (:func:`..sources.tables.replace_keyed`), as a folder a filing costs more
time than the filing's rows, and a filing is replaced as a whole.  Status: ``skipped`` (in the store already, unless
forced), ``missing`` (no page), ``failed`` (the page can't be read, or has no section with text; the store keeps what it
had), else ``loaded``.  A failure is a row and ends nothing.  A run that is broken off between the two
tables is run again: what is not in the store is not skipped.

Defined cases: several pages of one filing are read one after the other in the order of their texts' hashes; filings
wanted twice count once; a null ticker or year is no filing and is left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, models, text
from ..operators import chunking, stored
from ..sources import tables

KEYS = ["ticker", "year"]
SECTIONS = "item string, text string, error string, ticker string, year string"
NOTHING = "no chunks produced; the filing's sections could not be found"


def read_page(page: Column) -> Column:
    """struct(sections, error) of a page's HTML: what can't be read is an error and no exception."""

    @F.pandas_udf("sections array<struct<item:string,text:string>>, error string")
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            try:
                rows.append(([{"item": i, "text": t} for i, t in html.sections(html.page_text(page or ""))], None))
            except (ValueError, AssertionError, RecursionError) as problem:
                rows.append(([], f"{type(problem).__name__}: {problem}"))
        return pd.DataFrame(rows, columns=["sections", "error"])

    return run(page)


def stored_filings(spark: SparkSession, path: str) -> DataFrame:
    """ticker, year, chunks of what the store has."""
    rows = tables.existing(spark, f"{path}/store", "id string, ticker string, year string")
    return rows.groupBy(KEYS).agg(F.count("*").alias("chunks"))


def ingest(wanted: DataFrame, pages: DataFrame, path: str, force: bool = False) -> DataFrame:
    """``wanted(ticker, year)`` and ``pages(ticker, year, html)`` -> ticker, year, status, chunks, error."""
    spark = wanted.sparkSession
    wanted = wanted.select(KEYS).where("ticker IS NOT NULL AND year IS NOT NULL").distinct()
    run = tables.fresh_path(spark, "ingest")  # what this run has to do, as of before it
    (wanted if force else tables.missing(wanted, stored_filings(spark, path), KEYS)).write.parquet(run)
    todo = spark.read.schema("ticker string, year string").parquet(run)
    given = pages.where(F.col("html").isNotNull()).join(todo, KEYS, "left_semi").groupBy(KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.xxhash64("html"), "html"))), lambda p: p["html"]), "\n").alias("html"))
    told = given.select(*KEYS, read_page(F.col("html")).alias("r")).select(*KEYS, "r.error", F.explode_outer("r.sections").alias("s"))
    tables.replace_keyed(told.select("s.item", "s.text", "error", *KEYS), f"{path}/sections")

    sections = tables.read_partitions(spark, f"{path}/sections", SECTIONS).join(given.select(KEYS), KEYS, "left_semi")
    chunks = chunking.chunks(sections.where(F.col("item").isNotNull()), F.col("ticker"))
    passage = text.embed_text(F.col("company"), F.col("year"), F.col("section"), F.col("section_title"), F.col("text"))
    tables.replace_keyed(stored.rows(chunks, models.embedded(passage)), f"{path}/store")

    read = sections.groupBy(KEYS).agg(F.max("error").alias("error"), F.max(F.col("text").rlike(r"\S")).alias("any"))
    found = wanted.join(todo.withColumn("todo", F.lit(True)), KEYS, "left").join(read, KEYS, "left").join(stored_filings(spark, path), KEYS, "left").join(given.select(*KEYS, F.lit(True).alias("given")), KEYS, "left")
    good = F.coalesce("any", F.lit(False)) & F.col("error").isNull()
    status = F.when(F.col("todo").isNull(), "skipped").when(F.col("given").isNull(), "missing").when(good, "loaded").otherwise("failed")
    error = F.when(F.col("status") == "failed", F.coalesce("error", F.lit(NOTHING)))
    return found.withColumn("status", status).select(*KEYS, "status", F.when(F.col("status") == "loaded", F.col("chunks")).otherwise(0).alias("chunks"), error.alias("error"))


def summary(status: DataFrame) -> DataFrame:
    """AGG-6: status, n, chunks written, names of the filings in order (of one run's filings)."""
    names = F.array_sort(F.collect_list(F.concat_ws(" ", "ticker", "year")))
    return status.groupBy("status").agg(F.count("*").alias("n"), F.sum("chunks").alias("chunks"), F.array_join(names, ", ").alias("names"))
