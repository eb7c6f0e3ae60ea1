"""Language identification by word-first backoff.

A known word adds its per-language log frequency; an unseen word is scored by the
longest character n-grams of it that the model knows, falling back to shorter ones.
The fit uses a bounded sample of labelled rows (``per_language`` rows a language,
in expectation); all languages are learned, and prediction reads whole texts.

The model is sparse: it holds what a language that knows a word or n-gram scores above one
that does not, so its size is that of the kept counts, of which there are ``entries`` at most,
shared out evenly between languages (25 languages have the full lists).

Defined cases: null text or text without a letter -> ``und`` with score 0; no usable
training rows -> every text is ``und``; ties go to the alphabetically first language;
repeated rows give repeated results; rows with null lang are not learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sampled

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    per_language: int = 2000  # training rows of each language, in expectation
    words: int = 40_000  # known words kept of each language
    grams: int = 20_000  # n-grams kept of each language and length
    longest: int = 4  # of the character n-grams
    least: int = 2  # occurrences of a word or n-gram that is kept
    smoothing: float = 0.5
    entries: int = 3_000_000  # of all lists together


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] or [marked]


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def out() -> pd.DataFrame:
        rows = [(lang, word, c) for (lang, word), c in counts.items()]
        counts.clear()
        return pd.DataFrame(rows, columns=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for word, c in Counter(WORD.findall(text.lower())).items():
                counts[lang, word] += c
        if len(counts) > 500_000:
            yield out()
    yield out()


def _grams(batches: Iterator[pd.DataFrame], longest: int) -> Iterator[pd.DataFrame]:
    """n-grams of distinct words, each as often as its word."""
    for batch in batches:
        counts: Counter = Counter()
        for lang, word, c in zip(batch["lang"], batch["gram"], batch["n"], strict=True):
            for n in range(1, longest + 1):
                for g in grams(word, n):
                    counts[lang, n, g] += c
        yield pd.DataFrame([(*k, c) for k, c in counts.items()], columns=["lang", "size", "gram", "n"])


@dataclass
class Model:
    """``index[0]`` maps words and ``index[n]`` n-grams to rows.  Row r has what languages score above ``floors[n]``,
    the scores of a word or n-gram that a language does not know: ``gains[starts[r]:starts[r + 1]]`` for
    the languages ``whose`` there."""

    languages: list[str]
    index: list[dict[str, int]] = field(default_factory=list)
    floors: np.ndarray = None
    starts: np.ndarray = None
    whose: np.ndarray = None
    gains: np.ndarray = None
    cache: dict = field(default_factory=dict)

    def total(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Sum over ``rows``, each counted as often as it is named."""
        n = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return len(rows) * self.floors[size] + np.bincount(self.whose[at], weights=self.gains[at], minlength=len(self.languages))

    def unseen(self, word: str) -> np.ndarray:
        found = self.cache.get(word)
        if found is None:
            found = np.zeros(len(self.languages))
            for n in range(len(self.index) - 1, 0, -1):
                own = grams(word, n)
                rows = [r for g in own if (r := self.index[n].get(g)) is not None]
                if 2 * len(rows) >= len(own):
                    found = self.total(np.array(rows), n) / len(rows)
                    break
            if len(word) <= 64:  # bounds the cache, not what is read
                if len(self.cache) * (30 + len(self.languages)) > 4_000_000:  # some 32 MB
                    self.cache.clear()
                self.cache[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not self.languages or not (any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)):
            return UNKNOWN, 0.0
        get = self.index[0].get
        rows = np.array([get(w, -1) for w in words])
        total = self.total(rows[rows >= 0], 0)
        for k in np.flatnonzero(rows < 0).tolist():
            total = total + self.unseen(words[k])
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.languages[best], float(1 / p.sum())


def fit(train: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``train(doc_id, text, lang)``."""
    s = settings
    train = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    rates = train.sparkSession.createDataFrame([(lang, min(1.0, s.per_language / n)) for lang, n in sizes.items()], "lang string, rate double")
    chosen = train.join(F.broadcast(rates), "lang").where(sampled(F.col("doc_id"), "langid", F.col("rate"))).select("lang", "text")  # a row a language
    words = cut(chosen.mapInPandas(_words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counts = words.mapInPandas(lambda it: _grams(it, s.longest), "lang string, size int, gram string, n long")
    counts = counts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).unionByName(words.withColumn("size", F.lit(0)))
    counts = counts.where(F.col("n") >= s.least)
    order = F.expr("row_number() over (partition by lang, size order by n desc, gram)")
    share = min(1.0, s.entries / len(sizes) / (s.words + s.longest * s.grams))
    most = F.when(F.col("size") == 0, int(s.words * share)).otherwise(int(s.grams * share))
    return _model(counts.withColumn("r", order).where(F.col("r") <= most).drop("r").toArrow().to_pandas(), sorted(sizes), s)


def _model(kept: pd.DataFrame, languages: list[str], s: Settings) -> Model:
    at = {lang: i for i, lang in enumerate(languages)}
    index, floors, parts, base = [], [], [], 0
    for size in range(s.longest + 1):
        own = kept[kept["size"] == size]
        keys = sorted(own["gram"].unique())
        index.append({g: base + i for i, g in enumerate(keys)})
        rows, whose = own["gram"].map(index[size]).to_numpy(np.int64), own["lang"].map(at).to_numpy(np.int64)
        n = own["n"].to_numpy(float)
        whole = np.bincount(whose, weights=n, minlength=len(languages)) + s.smoothing * max(1, len(keys))
        floors.append(np.log(s.smoothing) - np.log(whole))
        parts.append((rows, whose, np.log1p(n / s.smoothing)))
        base += len(keys)
    rows, whose, gains = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((whose, rows))
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=base))]).astype(np.int64)
    return Model(languages, index, np.array(floors), starts, whose[order].astype(np.int32), gains[order].astype(np.float32))


def predictor(spark, model: Model):
    """A column function text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict
