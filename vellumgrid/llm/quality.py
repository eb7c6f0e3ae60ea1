"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``passage`` words.  Each passage is encoded as
h = tanh(W x) from its character-class statistics; gated attention weighs passages,
a_i = softmax_i(w . (tanh(V h_i) * sigmoid(U h_i))), and the document's score is
sigmoid(c . sum a_i h_i + b).  All weights are learned from document labels.

The fit uses a bounded sample of labelled rows (``rows``, in expectation), and of a longer
document ``train_passages`` passages at even distances; scoring reads every passage of every text.

Defined cases: null text counts as empty; an empty text is one empty passage; labels
that are null are left out, of duplicate labels the larger counts; no labels: score
0.5; one class only: its value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sampled, small

_SPECIAL = b"!?.,;:'\"-|#$%&*/@=<>()[]{}_\\^~+`"


@dataclass(frozen=True)
class Settings:
    passage: int = 48  # words
    rows: int = 5_000
    train_passages: int = 128
    hidden: int = 16
    gate: int = 8
    steps: int = 250
    learning_rate: float = 0.03
    ridge: float = 1e-4
    seed: int = 7


def _classes() -> np.ndarray:
    """Of each byte: 0 space, 1 newline, 2 lower, 3 upper, 4 digit, 5 non-ASCII,
    6 control, and one class for each special character."""
    out = np.full(256, 6, np.int64)
    out[32] = 0
    out[[9, 10, 11, 12, 13]] = 1
    out[97:123], out[65:91], out[48:58], out[128:] = 2, 3, 4, 5
    for i, b in enumerate(_SPECIAL):
        out[b] = 7 + i
    return out


CLASS = _classes()
N_CLASS = 7 + len(_SPECIAL)
#: coarse classes for pairs of neighbouring bytes
COARSE = np.array([0, 0, 1, 2, 3, 4, 5] + [6 if chr(b) in ".,;:'\"!?-()" else 7 for b in _SPECIAL])
#: a word's key is the sum of its bytes' numbers here (its first byte counts on its own)
MIX = np.random.default_rng(0).integers(0, 1 << 62, 256, dtype=np.uint64)
N_FEATURES = N_CLASS + 64 + 7


def encode(texts: list[str | None], passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(lengths)
    cls = CLASS[joined]
    space = cls < 2
    start = ~space & np.concatenate([[True], space[:-1]])
    at = np.flatnonzero(start)
    doc = np.searchsorted(ends, at, side="right")
    words = np.bincount(doc, minlength=len(raw))
    bags = np.maximum(1, -(-words // passage))
    base = np.cumsum(bags) - bags
    first = np.cumsum(words) - words
    which = base[doc] + (np.arange(len(at)) - first[doc]) // passage  # passage of each word
    # bytes before the first word of a text belong to its first passage
    owner = np.repeat(base, lengths)
    moved = np.zeros(len(joined), np.int64)
    new = np.flatnonzero(np.diff(which, prepend=-1) > 0)
    inner = new[which[new] > base[doc[new]]]
    moved[at[inner]] = 1
    step = np.cumsum(moved)
    owner = owner + step - np.repeat(np.concatenate([[0], step[ends[:-1] - 1]]) if len(raw) else step[:0], lengths)
    n = int(bags.sum())
    single = np.bincount(owner * N_CLASS + cls, minlength=n * N_CLASS).reshape(n, N_CLASS).astype(np.float32)
    coarse = COARSE[cls]
    both = np.bincount(owner[:-1] * 64 + coarse[:-1] * 8 + coarse[1:], minlength=n * 64).reshape(n, 64).astype(np.float32)
    size = single.sum(1, keepdims=True)
    count = np.bincount(which, minlength=n).astype(np.float32)
    # words: length, a hash, repeats
    stop = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    width = (stop - at).astype(np.float32)
    mixed = np.cumsum(MIX[joined], dtype=np.uint64)
    key = mixed[stop - 1] - mixed[at] + MIX[joined[at]] * np.uint64(3) + (stop - at).astype(np.uint64)
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (which[1:] == which[:-1])]) if len(at) else np.zeros(0, bool)
    order = np.lexsort((key, which))
    distinct = np.ones(len(at), bool)
    distinct[order[1:]] = (key[order[1:]] != key[order[:-1]]) | (which[order[1:]] != which[order[:-1]])
    total = lambda x: np.bincount(which, weights=x, minlength=n).astype(np.float32)
    c = np.maximum(count, 1)
    mean = total(width) / c
    spread = np.sqrt(np.maximum(total(width * width) / c - mean * mean, 0))
    extra = np.stack([mean / 10, spread / 10, total(distinct) / c, total(again) / c, np.log1p(count) / 4, (count > 0).astype(np.float32), np.log1p(size[:, 0]) / 6], axis=1)
    return np.concatenate([np.sqrt(single / size), np.sqrt(both / size), extra], axis=1).astype(np.float32), bags


@dataclass
class Model:
    mean: np.ndarray = None
    scale: np.ndarray = None
    parts: dict = None  # W, V, U, w, c, b
    constant: float = 0.5
    passage: int = 48

    def learned(self) -> bool:
        """Whether there was any label."""
        return self.parts is not None or self.constant != 0.5

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.parts is None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        x, bags = encode(texts, self.passage)
        return forward((x - self.mean) / self.scale, bags, self.parts)[0]


def forward(x: np.ndarray, bags: np.ndarray, m: dict):
    starts = np.cumsum(bags) - bags
    h = np.tanh(x @ m["W"])
    t, g = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * g) @ m["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), bags))
    a = e / np.repeat(np.add.reduceat(e, starts), bags)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["b"], -30, 30)))
    return p, (h, t, g, a, z, starts)


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, s: Settings) -> dict:
    """Full-batch Adam with the gradients of the gated attention written out."""
    rng = np.random.default_rng(s.seed)
    d, k, j = x.shape[1], s.hidden, s.gate
    m = {"W": rng.normal(0, d**-0.5, (d, k)), "V": rng.normal(0, k**-0.5, (k, j)), "U": rng.normal(0, k**-0.5, (k, j)), "w": rng.normal(0, j**-0.5, j), "c": rng.normal(0, k**-0.5, k), "b": np.zeros(1)}
    one, two = {n: np.zeros_like(v) for n, v in m.items()}, {n: np.zeros_like(v) for n, v in m.items()}
    for step in range(1, s.steps + 1):
        p, (h, t, g, a, z, starts) = forward(x, bags, m)
        dl = (p - y) / len(y)
        dz = dl[:, None] * m["c"]
        wide = np.repeat(dz, bags, axis=0)
        da = (wide * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), bags))
        dt, dg = de[:, None] * m["w"] * g * (1 - t * t), de[:, None] * m["w"] * t * g * (1 - g)
        dh = (a[:, None] * wide + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
        grads = {"W": x.T @ dh, "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dl, "b": np.array([dl.sum()])}
        for n, v in m.items():
            q = grads[n] + s.ridge * v * (n != "b")
            one[n], two[n] = 0.9 * one[n] + 0.1 * q, 0.999 * two[n] + 0.001 * q * q
            m[n] = v - s.learning_rate * (one[n] / (1 - 0.9**step)) / (np.sqrt(two[n] / (1 - 0.999**step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, y)``, y 0 or 1."""
    s = settings
    labels = labels.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    n = labels.count()
    if not n:
        return Model()
    chosen = small(cut(labels.where(sampled(F.col("doc_id"), "quality", min(1.0, s.rows / n)))), 4 * s.rows)

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                x, bags = encode(list(part["text"]), s.passage)
                ends = np.cumsum(bags)
                bag = lambda i: x[ends[i] - bags[i] + np.arange(min(bags[i], s.train_passages)) * max(bags[i], s.train_passages) // s.train_passages]  # noqa: B023, E731
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "y": part["y"].to_numpy(), "n": np.minimum(bags, s.train_passages), "x": [bag(i).tobytes() for i in range(len(bags))]})

    joined = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y")
    rows = joined.mapInPandas(passages, "doc_id long, y int, n int, x binary").toPandas().sort_values("doc_id")
    if not len(rows):
        return Model()
    y = rows["y"].to_numpy(float)
    if y.min() == y.max():
        return Model(constant=float(y[0]))
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, N_FEATURES)
    mean, scale = x.mean(0), x.std(0) + 0.02
    return Model(mean, scale, train((x - mean) / scale, rows["n"].to_numpy(), y, s), passage=s.passage)


def scorer(spark, model: Model):
    """A column function text -> score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        texts, out = list(texts), []
        for at in range(0, len(texts), 256):
            out.append(shared.value.score(texts[at : at + 256]))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return scored
