"""Incremental ingest of new pages: a file stream whose batches upsert by (ticker, year).

An extension: the batch functions are the same, a stream only finds the new files.  The
checkpoint makes each file count once, and a repeated batch rewrites the same partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import replace_partitions


def start(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform):
    """``transform`` maps a batch of pages to rows with ticker and year."""

    def land(batch: DataFrame, _: int) -> None:
        replace_partitions(transform(batch), target)

    pages = spark.readStream.schema(schema).parquet(source)
    return pages.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
