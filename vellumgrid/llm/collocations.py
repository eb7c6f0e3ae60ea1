"""Phrase collocation mining by hierarchical pair naming.

A word's id is a hash of it and its language.  From level to level, the ids of frequent phrases of
k-1 words that stand side by side (they overlap in all but one word) are replaced by the id of their
pair, a phrase of k words.  Pairs are counted in every task and joined globally by their two
parts; those that are frequent make up the level's table (id, left, right, a).  An id is a 64-bit mix of its
parts' ids, so that every task names a pair alike, and a bitmap of the level's ids tells which
pairs go on to the next level.  A bitmap may let a rare pair pass, which is then counted and dropped, and
never loses a frequent one, so counts are exact: every part of a frequent phrase is frequent.

left and right are pointers to the phrase without its last and without its first word.  Along
them, a phrase inherits its words and the counts of all its beginnings (from the left parent) and
endings (from the right one), which are what its cuts need; a phrase is dropped if it is a parent of a
longer one that covers it.  Only the parents need a look: a longer phrase is no more frequent than any phrase
between the two, so what is covered at all is covered by a phrase one word longer.

Nothing that grows with the corpus is collected or broadcast but the bitmaps (64 MB at most each).  Texts are
read once for each length.  Ids are 64-bit: of a billion phrases, two share one with a probability of 3 %.

Defined cases: null text is empty, null lang is ``und``; an empty table and one without frequent
phrases give no row; repeated rows count once each; other columns are not looked at; a phrase stays
within its piece, and a text of any length is worked on in parts of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Members, by_size, cut, members, release, small, stored
from .suffix_tree import BASE, PIECE, _batched, _hashes, _mixed

UNKNOWN = "und"
#: Pairs that a task counts at once.
COUNTED = 2_000_000
BLANKS, BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
#: Of each byte: 0 belongs to a word, 1 stands between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(BREAKS)] = 2


@dataclass(frozen=True)
class Settings:
    least: int = 100  # occurrences of a phrase
    longest: int = 5  # words of one
    scale: int = 1000  # of scores
    cover: int = 100  # per cent of a phrase's occurrences that a longer one needs to drop it
    top: int = 2000  # phrases a language


@dataclass
class Words:
    """The words of some texts one after the other."""

    ids: np.ndarray
    joined: np.ndarray  # whether the word stands in one piece with the one before it
    text: np.ndarray  # number of its text
    begin: np.ndarray
    stop: np.ndarray
    data: np.ndarray
    langs: list[str]  # of each text


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    import xxhash

    for batch in batches:
        for part in by_size(batch, most=PIECE):
            texts = pc.fill_null(part.column("text"), "").cast(pa.string())
            edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
            edges = edges - edges[0]
            kind = KIND[data]
            word, new = kind == 0, np.zeros(len(data) + 1, bool)
            new[edges] = True  # a text begins or ends
            gap = np.concatenate([[True], ~word, [True]])
            begin = np.flatnonzero(word & (gap[:-2] | new[:-1]))
            stop = np.flatnonzero(word & (gap[2:] | new[1:])) + 1
            text = np.searchsorted(edges, begin, side="right") - 1
            breaks = np.cumsum(kind == 2)[begin] if len(begin) else begin
            joined = np.zeros(len(begin), bool)
            joined[1:] = (breaks[1:] == breaks[:-1]) & (text[1:] == text[:-1])
            langs = pc.fill_null(part.column("lang"), UNKNOWN).to_pylist()
            of = {lang: xxhash.xxh3_64_intdigest(lang.encode()) for lang in set(langs)}
            salt = np.array([of[lang] for lang in langs], np.uint64)
            ids = _mixed(_hashes(data, begin, stop) * np.uint64(BASE) + salt[text])
            yield Words(ids, joined, text, begin, stop, data, langs)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The id of a pair."""
    return _mixed(left * np.uint64(BASE) + right)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each megabyte or so with their number: lang, id, word, a."""
    for w in _words(batches):
        ids, at, n = np.unique(w.ids, return_index=True, return_counts=True)
        raw = w.data.tobytes().lower()
        spelt = [raw[b:e] for b, e in zip(w.begin[at].tolist(), w.stop[at].tolist(), strict=True)]
        langs = [w.langs[t] for t in w.text[at].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids.view(np.int64)), pa.array(spelt, pa.binary()).cast(pa.string()), pa.array(n)], ["lang", "id", "word", "a"])


def _pairs(w: Words, levels: list[Members]) -> tuple[np.ndarray, np.ndarray]:
    """Left and right ids of all pairs of known phrases of ``len(levels)`` words."""
    ids, apart = w.ids, ~w.joined[1:]
    ok = levels[0].has(ids)
    for k, known in enumerate(levels):
        if k:
            # phrases of k + 1 words, each named at its first word
            at = np.flatnonzero(ok[:-1] & ok[1:] & ~apart[: len(ok) - 1])
            longer, told = np.zeros(max(len(ids) - 1, 0), np.uint64), np.zeros(max(len(ids) - 1, 0), bool)
            longer[at] = _pair(ids[at], ids[at + 1])
            told[at] = known.has(longer[at])
            ids, ok = longer, told
    at = np.flatnonzero(ok[:-1] & ok[1:] & ~apart[: max(len(ok) - 1, 0)])
    return ids[at], ids[at + 1]


def _count_pairs(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for left, right in _batched(parts, COUNTED):
        at, n = np.unique(_pair(left, right), return_index=True, return_counts=True)[1:]
        made = pa.RecordBatch.from_arrays([pa.array(left[at].view(np.int64)), pa.array(right[at].view(np.int64)), pa.array(n)], ["left", "right", "a"])
        del left, right, at, n  # not held while the next are gathered
        yield made
        del made


def _counted(docs: DataFrame, levels: list[Members]) -> DataFrame:
    """left, right, a of all pairs of known phrases."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count_pairs(_pairs(w, shared.value) for w in _words(batches))

    return docs.mapInArrow(count, "left long, right long, a long").groupBy("left", "right").agg(F.sum("a").alias("a"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(c).to_numpy().view(np.uint64) for c in ("left", "right"))
        yield pa.RecordBatch.from_arrays([pa.array(_pair(left, right).view(np.int64)), *batch.columns], ["id", *batch.schema.names])


def phrases(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs(text, lang)`` -> every frequent phrase of two words and more: lang, id, left, right, k, phrase, a,
    n, begins (counts of its first 1, 2, ... words, itself last), ends (of its last words, likewise)."""
    s, docs = settings, docs.select("text", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    words = stored(docs.mapInArrow(_count_words, "lang string, id long, word string, a long").groupBy("lang", "id", "word").agg(F.sum("a").alias("a")), "words")
    totals = small(cut(words.groupBy("lang").agg(F.sum("a").alias("n"))))
    own = F.array("a")
    level = stored(words.where(F.col("a") >= s.least).join(totals, "lang").select("lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", "n", own.alias("begins"), own.alias("ends")), "level")
    release(words)
    filters, made = [members(level, "id")], None
    for k in range(2, s.longest + 1):
        pairs = stored(_counted(docs, filters).where(F.col("a") >= s.least).mapInArrow(_named, "id long, left long, right long, a long"), "pairs")
        if not pairs.limit(1).count():
            break
        filters.append(members(pairs, "id"))
        left = level.select(F.col("id").alias("left"), "lang", "n", F.col("phrase").alias("first"), "begins")
        right = level.select(F.col("id").alias("right"), "last", "ends")
        told = pairs.join(left, "left").join(right, "right")
        level = stored(told.select("lang", "id", "left", "right", F.lit(k).alias("k"), F.concat_ws(" ", "first", "last").alias("phrase"), "last", "a", "n", F.concat("begins", own).alias("begins"), F.concat("ends", own).alias("ends")), "level")
        release(pairs)
        made = level if made is None else made.unionByName(level)
    if made is None:
        spark = docs.sparkSession
        return spark.createDataFrame([], "lang string, id long, left long, right long, k int, phrase string, a long, n long, begins array<long>, ends array<long>")
    return made.drop("last")


def scored(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The lowest-scoring cut of each of :func:`phrases` (ties: the earliest): adds cut, l, r, score."""
    s = settings
    wide = lambda c: c.cast("decimal(38,0)")

    def at(j):
        l, r = F.get("begins", j - 1), F.get("ends", F.col("k") - j - 1)
        # a decimal of 38 digits holds scale * a * n up to a corpus of 10^17 words
        score = F.call_function("div", F.lit(s.scale) * wide(F.col("a")) * wide(F.col("n")), wide(l) * wide(r))
        return F.struct(score.alias("score"), j.alias("cut"), l.alias("l"), r.alias("r"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.col("k") - 1), at))
    return found.withColumn("best", best).select(*found.columns, "best.cut", "best.l", "best.r", "best.score")


def uncovered(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Those of :func:`phrases` that no longer phrase covers."""
    begins, ends = (F.get(c, F.col("k") - 2) for c in ("begins", "ends"))
    covered = lambda parent, of: found.where((F.col("k") > 2) & (100 * F.col("a") >= settings.cover * of)).select(F.col(parent).alias("id"))
    gone = covered("left", begins).unionByName(covered("right", ends)).distinct()
    return found.join(gone, "id", "left_anti")


def mine(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs(text, lang)`` -> the ``top`` phrases of each language: lang, rank, phrase, k, cut, a, l, r, n, score."""
    rows = scored(uncovered(phrases(docs, settings), settings), settings)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.top).select("lang", "rank", "phrase", "k", "cut", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 100
), cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS first, array_to_string(list_slice(w, j + 1, k), ' ') AS rest
  FROM c, (SELECT unnest([1, 2, 3, 4]) AS j) WHERE j < k
), told AS (
  SELECT cuts.*, x.a AS l, y.a AS r, n, (1000 * CAST(cuts.a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(x.a AS HUGEINT) * CAST(y.a AS HUGEINT)) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN totals ON totals.lang = cuts.lang
), best AS (
  SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank,
       phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
