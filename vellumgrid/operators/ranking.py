"""Dense top-k, reciprocal rank fusion, quotas (SRT, WIN-3, JON-3, JON-4, MTH-1..4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import CANDIDATES, PER_COMPANY, RRF_K
from . import stored

#: Most query vectors that are joined at once; more come in further blocks.
QUERY_BLOCK = 2048


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, groups: tuple[str, ...] = ()) -> DataFrame:
    """``queries(qid, q)`` against ``vectors(id, v, ...)``: qid, *groups, id, distance, rank; exact.

    Counted blocks of queries go to the scan of the vectors, where they meet in matrix products; each task
    passes on what may be among the k best.  Null, zero and non-finite vectors, and pairs of different
    dimensions, take no part."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    made = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        found = stored.dense_lists(own.select("qid", "q"), vectors, k, groups)
        made = found if made is None else made.unionByName(found)
    order = Window.partitionBy("qid", *groups).orderBy(F.round("distance", 9), "id")
    return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(dense: DataFrame, keyword: DataFrame, n: Column | int) -> DataFrame:
    """``(qid, id, rank)`` twice -> qid, id, score, rank: ties go to the dense list."""
    both = dense.select("qid", "id", F.col("rank").alias("dr")).join(keyword.select("qid", "id", F.col("rank").alias("kr")), ["qid", "id"], "full_outer")
    term = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", term("dr") + term("kr"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("dr"), F.asc_nulls_last("kr"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("qid", "id", "score", "rank")


def materialise(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """JON-4: payload joins after the cut; ids that chunks lack vanish."""
    return ranked.join(chunks, "id")


def quota(k: int, companies: Column) -> Column:
    """SRT-6."""
    return F.greatest(F.lit(PER_COMPANY), F.ceil(F.lit(k) / companies)).cast("int")
