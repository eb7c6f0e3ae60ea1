"""Inverted index and BM25 (SRC-11, SNK-8, AGG-8, SRT-2).

Statistics are those of the whole index; filters restrict the rows that are ranked.
A query is an OR of phrases; words of a phrase stand next to each other.  The few query
terms are joined with the occurrences before anything is shuffled; a stored index
(``postings``, sorted by term) is read instead of the texts through :func:`stored`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import B, CANDIDATES, IDF_FLOOR, K1
from ..functions.models import stemmed
from ..functions.text import words


@dataclass(frozen=True)
class Index:
    occurrences: DataFrame  # term, id, pos
    lengths: DataFrame  # id, dl
    stats: DataFrame  # one row: n, avgdl

    def postings(self) -> DataFrame:
        """term, id, positions: the form in which an index is written."""
        return self.occurrences.groupBy("term", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))

    def term_df(self) -> DataFrame:
        return self.occurrences.select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("df"))


def stored(postings: DataFrame, lengths: DataFrame) -> Index:
    """An index from its written tables."""
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings.select("term", "id", F.explode("positions").alias("pos")), lengths, stats)


def build(chunks: DataFrame, stem: bool = False, pattern: str = "[a-z0-9]+") -> Index:
    """``chunks(id, text)``.  Null text has no terms but counts in n."""
    terms = words(F.col("text"), pattern)
    rows = chunks.select("id", (stemmed(terms) if stem else terms).alias("terms"))
    lengths = rows.select("id", F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("dl"))
    lengths = lengths.withColumn("dl", F.greatest("dl", F.lit(0)))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(rows.select("id", F.posexplode("terms").alias("pos", "term")).select("term", "id", "pos"), lengths, stats)


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """``queries(qid, phrases array<array<string>>)`` -> qid, id, score."""
    phrases = queries.select("qid", F.explode(F.array_distinct("phrases")).alias("phrase"))
    asked = phrases.select("phrase").distinct().select("phrase", F.posexplode("phrase").alias("at", "term"))
    spots = index.occurrences.join(asked, "term").select("phrase", "id", (F.col("pos") - F.col("at")).alias("start"))
    starts = spots.groupBy("phrase", "id", "start").agg(F.count("*").alias("hits"))
    tf = starts.where(F.col("hits") == F.size("phrase")).groupBy("phrase", "id").agg(F.count("*").alias("f"))
    df = tf.groupBy("phrase").agg(F.count("*").alias("df"))
    n, f, dl = F.col("n"), F.col("f"), F.col("dl")
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, IDF_FLOOR).otherwise(idf)
    parts = tf.join(df, "phrase").join(index.lengths, "id").join(F.broadcast(index.stats))  # stats: one row
    parts = parts.select("phrase", "id", (weight * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / F.col("avgdl")))).alias("part"))
    return parts.join(phrases, "phrase").groupBy("qid", "id").agg(F.sum("part").alias("score"))


def search(index: Index, queries: DataFrame, chunks: DataFrame | None = None, where: Column | None = None, n: int = CANDIDATES) -> DataFrame:
    """qid, id, score, rank of the n best; ``where`` filters ``chunks(id, ...)``."""
    found = scores(index, queries)
    if where is not None:
        found = found.join(chunks.where(where).select("id"), "id", "left_semi")
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
