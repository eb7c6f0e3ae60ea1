"""Incremental keyword index: takes the files of documents that are new and indexes what they hold.

    python -m jobs.index_new --documents IN --out OUT --checkpoint AT [--config jobs/index_new.json]

A file stream with a checkpoint finds the new files; each batch of files gets a status a document and
adds its documents to the index:

* ``OUT/index``: a row a document with its terms and their places, in partitions batch, ticker, year;
* ``OUT/log``: doc_id, status, words of every document of the batch, in partitions batch, status.

Status: ``missing`` (no text), ``failed`` (a text without a word), ``skipped`` (the text that the index
has already), else ``loaded``.  A document that comes again with another text is loaded again, and its
last batch counts; one that comes again without a usable text stays as it was.

Runs again safely: a batch that was broken off comes again with the same files and number, and
overwrites its own partitions; what a batch compares with is the index of the batches before it.  A run without new
files writes nothing.  OUT and AT belong together: a new checkpoint needs a new OUT.

Defined cases: of rows of one batch that share a doc_id, the one whose text has the largest MD5 counts; a null
doc_id is one document; an empty source is no company; other columns are not looked at.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumgrid.operators import stored
from vellumgrid.sources.tables import read_config

log = logging.getLogger("index_new")

KEYS = ("batch", "ticker", "year")
INDEX = "id long, section string, digest string, dl long, terms array<string>, counts array<int>, positions array<int>, v array<double>, batch long, ticker string, year string"
LOG = "doc_id long, words long, batch long, status string"


def index(spark: SparkSession, out: str) -> DataFrame:
    """The index of all batches; a document may be in several."""
    return spark.read.schema(INDEX).parquet(f"{out}/index")


def newest(rows: DataFrame, key: str) -> DataFrame:
    """The rows of each key's last batch."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch")))
    return rows.withColumn("__last", last).where("__last = 1").drop("__last")


def live(spark: SparkSession, out: str) -> DataFrame:
    """The store as it stands, for :func:`vellumgrid.operators.stored.lists`."""
    return newest(index(spark, out), "id")


def current(spark: SparkSession, out: str) -> DataFrame:
    """Every document that ever came: its last status, and what the index has of it."""
    told = newest(spark.read.schema(LOG).parquet(f"{out}/log"), "doc_id").select("doc_id", "status")
    pairs = F.transform(F.arrays_zip("terms", "counts"), lambda p: F.concat(p["terms"], F.lit(":"), p["counts"].cast("string")))
    have = live(spark, out).select(F.col("id").alias("__id"), "ticker", "year", "section", F.col("dl").alias("words"), F.array_join(F.array_sort(pairs), " ").alias("terms"))
    return told.join(have, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")


def land(batch: DataFrame, number: int, out: str, first_year: int, years: int) -> None:
    """Index one batch of documents."""
    spark = batch.sparkSession
    log.info("batch %d: read %d rows", number, batch.count())
    rows = batch.select(F.col("doc_id").cast("long").alias("id"), "text", F.nullif("source", F.lit("")).alias("ticker"), F.col("lang").alias("section"), F.md5("text").alias("digest"))
    one = F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("digest"), F.asc_nulls_last("ticker"), F.asc_nulls_last("section")))
    year = (F.pmod("id", F.lit(years)) + first_year).cast("string")
    rows = rows.withColumn("__one", one).where("__one = 1").drop("__one").withColumn("year", year)
    made = stored.rows(rows)
    before = newest(index(spark, out).where(F.col("batch") < number), "id") if number else None
    same = F.lit(False)
    if before is not None:
        made = made.join(before.select(F.col("id").alias("__id"), F.col("digest").alias("__digest")), F.col("id").eqNullSafe(F.col("__id")), "left")
        same = F.coalesce(F.col("__digest") == F.col("digest"), F.lit(False))
    status = F.when(F.col("text").isNull(), "missing").when(same, "skipped").when(F.col("dl") == 0, "failed").otherwise("loaded")
    made = made.withColumns({"status": status, "batch": F.lit(number).cast("long")}).persist()
    stored.write(made.where("status = 'loaded'").select(*[c.split()[0] for c in INDEX.split(", ")]), f"{out}/index", KEYS)
    stored.write(made.select(F.col("id").alias("doc_id"), F.col("dl").alias("words"), "batch", "status"), f"{out}/log", ("batch", "status"))
    made.unpersist()
    told = spark.read.schema(LOG).parquet(f"{out}/log").where(F.col("batch") == number).groupBy("status").agg(F.count("*").alias("n"), F.sum("words").alias("words")).orderBy("status")
    for r in told.collect():  # a row a status
        log.info("batch %d: %s %d documents, %d words", number, r["status"], r["n"], r["words"] or 0)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, max_files: int = 1000, first_year: int = 2024, years: int = 3) -> DataFrame:
    """Index what is new below ``documents``, a folder or one file, and return :func:`current`."""
    given = spark.read.parquet(documents)
    new = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", max_files)
    folder, _, name = documents.rstrip("/").rpartition("/")
    if given.inputFiles() and all(f.endswith(f"/{name}") for f in given.inputFiles()):  # streams read folders
        new = new.option("pathGlobFilter", name).parquet(folder or ".")
    else:
        new = new.parquet(documents)
    writer = new.writeStream.foreachBatch(lambda batch, number: land(batch, number, out, first_year, years))
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: all read, index at %s/index", documents, out)
    return current(spark, out)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    told = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("index_new").getOrCreate()
    try:
        settings = read_config(spark, told.config) if told.config else {}
        by = run(spark, told.documents, told.out, told.checkpoint, **settings).groupBy("status").count().collect()
        log.info("%s holds %s", told.out, {r["status"]: r["count"] for r in by})
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
