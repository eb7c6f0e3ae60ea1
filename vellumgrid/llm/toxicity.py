"""Toxicity severity by cumulative-link (proportional odds) ordinal regression.

P(grade <= k | x) = sigmoid(cut_k - w.x): one weight vector, ordered thresholds.
Features are sparse and binary: the distinct words of a text and the prefixes of
``prefix`` letters of its longer words, all of them that occur in five rows of the bounded sample of
labelled rows and whose two-sided association with toxicity exceeds ``chi2`` there.

Grades: if the labels have more than one positive value, the labels are the grades.
A 0/1 label is graded 0 for a clean text and 1..``levels`` for a toxic one by how many
of the strongest toxic words it holds (thirds of the training rows that are toxic), so
that "more severe" has a meaning that the labels themselves support.

Defined cases: null or empty text holds no feature and gets the base rate; labels that
are null, and duplicate labels that disagree (the larger counts); no labels, or only
one class of them: every text gets the base rate of that class (0 without labels);
repeated documents count as often as they stand, and are scored alike; an empty table gives an
empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sampled, small

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    rows: int = 20_000  # labelled training rows, in expectation
    chi2: float = 30.0
    prefix: int = 4
    levels: int = 3
    ridge: float = 1e-5
    steps: int = 600
    learning_rate: float = 0.1


def features(text: str | None, prefix: int) -> set[str]:
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {w[:prefix] + "*" for w in words if len(w) > prefix}


def _present(batches: Iterator[pd.DataFrame], prefix: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(f, y) for text, y in zip(batch["text"], batch["y"], strict=True) for f in features(text, prefix)]
        out = pd.DataFrame(rows, columns=["feature", "y"]).assign(one=1)
        yield out.groupby(["feature", "y"], as_index=False)["one"].sum()[["feature", "y", "one"]]


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray  # ascending; none: one class only
    only: int = 0  # the grade if there are no cuts
    prefix: int = 4

    def grades(self) -> int:
        return len(self.cuts) + 1

    def distribution(self, linear: np.ndarray) -> np.ndarray:
        """Probability of each grade; a row for each value of the linear predictor."""
        below = 1 / (1 + np.exp(np.clip(linear[:, None] - self.cuts[None, :], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(linear), 1)), below, np.ones((len(linear), 1))], axis=1), axis=1)

    def linear(self, texts) -> np.ndarray:
        known = self.vocabulary.keys()
        # in a fixed order, so that sums do not differ from run to run in their last bits
        return np.array([sum(self.weights[self.vocabulary[f]] for f in sorted(features(t, self.prefix) & known)) for t in texts], float)


def regression(rows: list[list[int]], grade: np.ndarray, n_features: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by Adam on the penalised likelihood."""
    k = int(grade.max())
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], np.int64)
    share = np.array([(grade <= j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    cuts = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(n_features), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, s.steps + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        cuts = theta[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        x = np.bincount(at, weights=w[feature], minlength=len(rows))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = sig(edges[grade + 1] - x), sig(edges[grade] - x)
        p = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        gx = (dh - dl) / len(rows)  # of the negative likelihood in x
        gc = np.zeros(k)
        np.add.at(gc, grade[grade < k], -dh[grade < k] / len(rows))
        np.add.at(gc, grade[grade > 0] - 1, dl[grade > 0] / len(rows))
        after = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([np.bincount(feature, weights=gx[at], minlength=n_features) + s.ridge * w, [gc.sum()], after[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - s.learning_rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = theta[n_features] + np.concatenate([[0], np.cumsum(np.exp(theta[n_features + 1 :]))])
    return theta[:n_features], cuts


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, y)``, y a non-negative integer."""
    s = settings
    labels = labels.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    n = labels.count()
    if not n:
        return Model({}, np.zeros(0), np.zeros(0))
    chosen = small(cut(labels.where(sampled(F.col("doc_id"), "toxicity", min(1.0, s.rows / n)))), 4 * s.rows)
    train = cut(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "y"))
    total, toxic, low, high = train.agg(F.count("*"), F.count_if(F.col("y") > 0), F.min("y"), F.max("y")).first()
    if low == high:
        return Model({}, np.zeros(0), np.zeros(0), only=int(low or 0))
    counts = train.select("text", (F.col("y") > 0).cast("int").alias("y")).mapInPandas(lambda it: _present(it, s.prefix), "feature string, y int, one long")
    both = counts.groupBy("feature").agg(F.sum(F.col("one") * F.col("y")).alias("a"), F.sum(F.col("one") * (1 - F.col("y"))).alias("b"))
    a, b, p, q = F.col("a"), F.col("b"), F.lit(float(toxic)), F.lit(float(total - toxic))
    chi2 = (total * F.pow(a * (q - b) - b * (p - a), F.lit(2))) / ((a + b) * (total - a - b) * p * q)
    top = both.where((a + b < total) & (a + b >= 5)).withColumn("chi2", chi2).where(F.col("chi2") > s.chi2)
    top = top.withColumn("toxic", (a / p > b / q)).orderBy(F.desc("chi2"), "feature").toPandas()
    vocabulary = {f: i for i, f in enumerate(top["feature"])}
    strong = top["toxic"].to_numpy(bool)

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[vocabulary[f] for f in features(t, s.prefix) & vocabulary.keys()] for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "x": found})

    # at most ``rows`` labelled rows, in expectation
    rows = train.mapInPandas(sparse, "y int, x array<int>").toPandas()
    x, y = [sorted(map(int, r)) for r in rows["x"]], rows["y"].to_numpy(int)
    order = np.lexsort((np.array([hash(tuple(r)) for r in x]), y)) if len(x) else np.zeros(0, int)
    x, y = [x[i] for i in order], y[order]
    if y.max() == 1:  # grade the toxic rows
        hits = np.array([int(strong[r].sum()) if r else 0 for r in x])
        bounds = np.unique(np.quantile(hits[y == 1], np.arange(1, s.levels) / s.levels))
        grade = np.where(y == 1, 1 + np.searchsorted(bounds, hits, side="left"), 0)
    else:
        grade = y
    _, grade = np.unique(grade, return_inverse=True)
    weights, cuts = regression(x, grade, len(vocabulary), s)
    return Model(vocabulary, weights, cuts, prefix=s.prefix)


def scorer(spark, model: Model):
    """A column function text -> struct(severity, grade, score): the expected grade, the
    likeliest one, and the probability of any grade above 0."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        m: Model = shared.value
        if not len(m.cuts):
            return pd.DataFrame({"severity": [float(m.only)] * len(texts), "grade": [m.only] * len(texts), "score": [float(m.only > 0)] * len(texts)})
        p = m.distribution(m.linear(texts))
        return pd.DataFrame({"severity": p @ np.arange(m.grades()), "grade": p.argmax(1), "score": 1 - p[:, 0]})

    return scored
