"""Exact top-k by inner product with a pivot table (elimination by lower bounds).

<q,c> = (|q|^2 + |c|^2 - d(q,c)^2) / 2, and by the triangle inequality d(q,c) is at
least max_p |d(q,p) - d(c,p)|, which bounds the score from above.  The distances of all
vectors to the pivots are computed once and stored with them (the pivot table).  In each block
candidates are evaluated in the order of that bound until the k-th best score exceeds
every bound left; ties are evaluated too, so the result is exact.  The search starts from
a floor, the query's k-th best score among the sampled rows, which no result is below, so
that blocks need not find it anew and candidates bounded below it are not evaluated at all.

Queries and candidates meet in blocks (query block x candidate block) of bounded size,
one task group each; every group returns its k best, the rest is a top-k window.  The
pivots are chosen farthest-first from a bounded sample, and any choice is exact.

Defined cases: vectors that are null, empty, or hold null or non-finite components take
no part, nor do rows with a null id; vectors of different lengths are not compared;
repeated rows count once, different vectors that share an id are all candidates and, as
queries, share their k results; ties go to the smaller id; products must fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sampled


@dataclass(frozen=True)
class Settings:
    k: int = 5
    pivots: int = 64
    sample: int = 2048  # rows that pivots are chosen from, in expectation
    query_block: int = 2048
    candidate_block: int = 8192


def choose(vectors: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots."""
    if not len(vectors):
        return vectors
    picked = [int(np.argmax(np.einsum("ij,ij->i", vectors, vectors)))]
    far = np.linalg.norm(vectors - vectors[picked[0]], axis=1)
    while len(picked) < min(n, len(vectors)) and far.max() > 0:
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, np.linalg.norm(vectors - vectors[picked[-1]], axis=1))
    return vectors[picked]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T, 0))


def block_top(q: np.ndarray, qid: np.ndarray, qd: np.ndarray, floor: np.ndarray, c: np.ndarray, cid: np.ndarray, cd: np.ndarray, k: int):
    """(query row, candidate row, score) of the k best of each query, and the number of
    products that were evaluated.  ``qd`` and ``cd`` are distances to the pivots; results below ``floor``
    may be missing.  ``c`` is sorted by id."""
    exact = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1] < 1 << 52
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    qi, ci = (qf, cf) if exact else (q, c)
    qn, cn = (qf**2).sum(1), (cf**2).sum(1)
    out, evaluated = [], 0
    for i in range(len(q)):
        low = np.zeros(len(c))
        for p in range(qd.shape[1]):
            np.maximum(low, np.abs(cd[:, p] - qd[i, p]), out=low)
        low = np.maximum(low * (1 - 1e-9) - 1e-6 * (1 + qd[i].max(initial=0)), 0)
        bound = (qn[i] + cn - low * low) / 2
        bound += 1e-6 * (1 + np.abs(bound))
        bound[cid == qid[i]] = -np.inf
        able = np.flatnonzero(bound >= floor[i])
        order = able[np.argsort(-bound[able], kind="stable")]
        rows, scores, at, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, max(64, k)
        while at < len(order) and bound[order[at]] > -np.inf and (len(rows) < k or bound[order[at]] >= scores[-1]):
            take = order[at : at + size]
            take = take[bound[take] > -np.inf]
            evaluated += len(take)
            rows = np.concatenate([rows, take])
            scores = np.concatenate([scores, (ci[take] @ qi[i]).astype(np.int64)])
            best = np.lexsort((cid[rows], -scores))[:k]
            rows, scores, at, size = rows[best], scores[best], at + size, size * 2
        out.append((np.full(len(rows), i), rows, scores))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return *(np.concatenate([o[j] for o in out]) for j in range(3)), evaluated


def quantised(vectors: DataFrame, key: str, embedding: str, scale: int = 256) -> DataFrame:
    """id, x: floor(scale * component) of the rows that take part."""
    x = F.col(embedding)
    wide = F.transform(x, lambda v: v.cast("double"))
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(wide, lambda v: F.floor(v * scale)).alias("x"))


def top_k(vectors: DataFrame, is_query, settings: Settings = Settings()) -> DataFrame:
    """``vectors(id, x array<long>)``; ``is_query`` a condition on id.  Returns
    query_id, rank, vec_id, score."""
    s = settings
    rows = cut(vectors.select("id", "x").distinct().select("id", "x", is_query.alias("q"), F.size("x").alias("dim")))
    n, nq = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    sample = rows.where(sampled(F.col("id"), "pivots", min(1.0, s.sample / max(1, n)))).select("id", "x", "dim").orderBy("id").toPandas()
    pivots = {d: (choose(x := np.array(g["x"].tolist(), np.int64), s.pivots).astype(np.float64), g["id"].to_numpy(), x) for d, g in sample.groupby("dim")}
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Distances to the pivots, and a query's floor."""
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                at, ids, seeds = shared.value.get(int(dim), (np.zeros((0, int(dim))), np.zeros(0, np.int64), np.zeros((0, int(dim)), np.int64)))
                x = np.array(own["x"].tolist(), np.int64)
                floor = [_floor(v, i, seeds, ids, s.k) if q else None for v, i, q in zip(x, own["id"], own["q"], strict=True)]
                yield own.assign(far=list(distances(x.astype(np.float64), at)), floor=pd.Series(floor, own.index, dtype="object"))

    rows = cut(rows.mapInPandas(described, "id long, x array<long>, q boolean, dim int, far array<double>, floor double"))
    cbs, qbs = max(1, -(-n // s.candidate_block)), max(1, -(-nq // s.query_block))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cand = rows.select("id", "x", "dim", "far", F.pmod(F.xxhash64(F.lit("c"), "id", "x"), F.lit(cbs)).cast("int").alias("cb"), every(qbs).alias("qb"))
    query = rows.where("q").select("id", "x", "dim", "far", "floor", F.pmod(F.xxhash64(F.lit("q"), "id", "x"), F.lit(qbs)).cast("int").alias("qb"), every(cbs).alias("cb"))

    def best(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        cs = cs.sort_values("id")
        sides = [(np.array(f["x"].tolist(), np.int64), f["id"].to_numpy(), np.array(f["far"].tolist(), np.float64).reshape(len(f), -1)) for f in (qs, cs)]
        floor = qs["floor"].fillna(-np.inf).to_numpy(np.float64)
        i, j, score, _ = block_top(*sides[0], floor, *sides[1], s.k)
        return pd.DataFrame({"query_id": sides[0][1][i], "vec_id": sides[1][1][j], "score": score})

    keys = ("dim", "qb", "cb")
    found = query.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floor(x: np.ndarray, own: int, seeds: np.ndarray, ids: np.ndarray, k: int) -> float | None:
    """The k-th best score of ``x`` among the seeds, less what a double may round off."""
    scores = seeds[ids != own] @ x
    if len(scores) < k:
        return None
    kth = float(np.partition(scores, len(scores) - k)[len(scores) - k])
    return kth - 1e-9 * abs(kth)
