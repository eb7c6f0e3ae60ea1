"""A written retrieval store (SNK-4..10, SRC-11, SRT-1, AGG-8): a row a chunk, with its terms, their
places, and its vector of length one, partitioned by filing.

* Replacing a filing rewrites its partitions only.  Statistics (number of chunks, mean length, chunks
  that have a phrase) are taken from the rows as they stand, so that scores after it are those of
  a store written anew.
* ``SCAN`` asks are answered by two scans of the store: one counts the chunks that have
  each asked phrase, one scores.  An Arrow batch of chunks meets the asks, ``BLOCK`` at a time, in matrix products (weights of
  the phrases that many of them ask and many chunks have, vectors; other phrases are added hit by hit), under the asks' filters.  Each
  task keeps the best of each ask and passes these on when it has seen all its chunks, so no other pair of chunk and ask is shuffled.
* The words and vectors of ``SCAN`` asks go to all tasks; the store is never collected.

Defined cases: a null text has no terms, counts in the number of chunks and has no vector; null, zero
and non-finite vectors, and those of another size than the ask's, are in no dense list; an ask without words gets nothing;
ties go to the smaller id; an empty store and no asks give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import B, CANDIDATES, IDF_FLOOR, K1
from ..functions.text import words

#: Asks of one scan (if they are words only), vectors that are met at once, and chunks that they meet at once.
SCAN, SCAN_WORDS, BLOCK, ROWS = 8192, 1 << 18, 256, 1024
#: Phrases of a block with a vector over its rows, its hits, and pairs of ask and chunk that are scored as they are at once.
WIDE, HITS, PAIRS = 512, 5 << 19, 1 << 17
#: From so many pairs of ask and chunk on, one chunk in a few is asked first: what the k-th best of these reaches, that of all reaches.
FLOORS = 1 << 28
#: Words that are sorted at once.
PART = 1 << 18


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _sorted_terms(lists: pa.Array) -> pa.Array:
    values, n = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    doc, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    code = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(doc * max(len(values.dictionary), 1) + code, kind="stable")
    own = (doc * max(len(values.dictionary), 1) + code)[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(own)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc[order][first], minlength=len(n)))]).astype(np.int32)
    place = (np.arange(len(doc)) - start[doc])[order].astype(np.int32)
    listed = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), x)
    found = values.dictionary.take(pa.array(code[order][first])).cast(pa.string())
    return pa.StructArray.from_arrays([pa.array(n), listed(ends, found), listed(ends, pa.array(counts.astype(np.int32))), listed(np.concatenate([[0], np.cumsum(n)]), pa.array(place))], ["dl", "terms", "counts", "positions"])


def term_lists(lists: pa.Array) -> pa.Array:
    """As :func:`grouped_terms`, about ``PART`` words at a time."""
    lists = lists.fill_null(pa.scalar([], lists.type))
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    made, at = [], 0
    while at < len(lists) or not made:  # a part of the words at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, side="right")))
        made.append(_sorted_terms(lists[at:to]))
        at = to
    return pa.concat_arrays(made)


def grouped_terms(terms: Column) -> Column:
    """Array of words -> struct(dl, terms: each once, counts of each, positions of all, one after the other)."""

    @F.arrow_udf("dl long, terms array<string>, counts array<int>, positions array<int>")
    def run(lists: pa.Array) -> pa.Array:
        return term_lists(lists)

    return run(terms)


def units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, values scaled to length one, and which rows can be ranked at all."""
    lists = vectors.fill_null(pa.scalar([], vectors.type))
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(n)), n)
    norm = np.sqrt(np.bincount(of, weights=x * x, minlength=len(n)))
    good = np.isfinite(norm) & (norm > 0)
    return n, x / np.where(good, norm, 1.0)[of], good


def unit_vector(vector: Column) -> Column:
    """The vector at length one; null for one that can't be ranked."""

    @F.arrow_udf("array<double>")
    def run(vectors: pa.Array) -> pa.Array:
        n, x, good = units(vectors)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(x), mask=pa.array(~good))

    return run(vector)


def rows(chunks: DataFrame, vector: Column | None = None, pattern: str = "[a-z0-9]+") -> DataFrame:
    """``chunks(id, ticker, year, section, text, ...)`` -> the store's rows: all columns, dl, terms, counts, positions, v."""
    told = chunks.withColumn("__t", grouped_terms(words(F.col("text"), pattern)))
    vector = F.lit(None).cast("array<double>") if vector is None else unit_vector(vector)
    return told.withColumn("v", vector).select(*chunks.columns, "__t.*", "v")


def dealt(chunks: DataFrame, keys: tuple[str, ...] = ("ticker", "year")) -> DataFrame:
    """Dealt out by filing, large ones to several tasks, so that a filing is a few files and not one of every task."""
    return chunks.hint("rebalance", *keys)


def write(made: DataFrame, path: str, keys: tuple[str, ...] = ("ticker", "year"), done: bool = False) -> None:
    """Write the filings of ``made``, each in place of what the store has of it.  They are dealt out first, unless that is
    ``done``, best with the chunks: their terms and places are several times as large."""
    own = made if done else dealt(made, keys)
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The store at ``path``, whose rows have the columns of ``like``; years stay strings."""
    return spark.read.schema(like.schema).parquet(path)


class _Phrases:
    """The distinct phrases of many asks, by number, and which of them each ask has."""

    def __init__(self, asked: pa.Array):
        asked = asked.fill_null(pa.scalar([], asked.type))
        of, phrases = np.repeat(np.arange(len(asked)), _lengths(asked)), asked.flatten()
        phrases = phrases.fill_null(pa.scalar([], phrases.type))
        n, words = _lengths(phrases), phrases.flatten().dictionary_encode()
        self.array = words.dictionary.cast(pa.string())
        code, ends, number = words.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(n), np.full(len(phrases), -1)
        number[n == 1] = code[ends[n == 1] - 1]
        several: dict = {}
        for i in np.flatnonzero(n > 1).tolist():
            p = tuple(code[ends[i] - n[i] : ends[i]].tolist())
            if min(p) >= 0:
                number[i] = len(self.array) + several.setdefault(p, len(several))
        self.several = [(len(self.array) + k, p) for p, k in several.items()]
        self.size, self.asks = len(self.array) + len(several), len(asked)
        self.single = np.bincount(number[(n == 1) & (number >= 0)], minlength=len(self.array)) > 0
        own = np.unique(of[number >= 0] * max(self.size, 1) + number[number >= 0])
        self.code = (own % max(self.size, 1)).astype(np.int32)  # of one ask after the other
        self.n = np.bincount(own // max(self.size, 1), minlength=self.asks)
        self.start = np.cumsum(self.n) - self.n

    def parts(self, asks: int) -> Iterator[tuple[int, int]]:
        return ((a, min(a + asks, self.asks)) for a in range(0, self.asks, asks))

    def codes(self, first: int, last: int) -> np.ndarray:
        """The phrases of asks from ``first`` to before ``last``; :meth:`ask_of` tells whose they are, from 0 on."""
        return self.code[self.start[first] : self.start[last - 1] + self.n[last - 1]]

    def ask_of(self, first: int, last: int) -> np.ndarray:
        return np.repeat(np.arange(last - first), self.n[first:last])

    def columns(self) -> list[str]:
        return ["terms", "counts", "positions"] if self.several else ["terms", "counts"]

    def hits(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, phrase and number of places of each phrase that a chunk has."""
        lists, counts = part.column("terms"), part.column("counts").flatten().to_numpy(zero_copy_only=False)
        code = pc.fill_null(pc.index_in(lists.flatten(), self.array), -1).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
        at = np.flatnonzero(code >= 0)
        one = at[self.single[code[at]]]
        found = [(of[one], code[one], counts[one])]
        if self.several:
            places, ends = part.column("positions").flatten().to_numpy(zero_copy_only=False), np.cumsum(counts)
            spots = {(r, c): k for r, c, k in zip(of[at].tolist(), code[at].tolist(), at.tolist(), strict=True)}
            have = lambda r, c: places[ends[k] - counts[k] : ends[k]] if (k := spots.get((r, c))) is not None else places[:0]
            for phrase, codes in self.several:
                for r in np.unique(of[at[code[at] == codes[0]]]).tolist():
                    start = have(r, codes[0])
                    for k, c in enumerate(codes[1:], 1):
                        start = np.intersect1d(start, have(r, c) - k, assume_unique=True)
                    if len(start):
                        found.append((np.array([r]), np.array([phrase]), np.array([len(start)])))
        r, phrase, f = (np.concatenate(x) for x in zip(*found, strict=True))
        return r.astype(np.int32), phrase.astype(np.int32), f


class _Best:
    """The k best values of each of many asks so far, so that what is below all of them is left out."""

    def __init__(self, asks: int, k: int):
        self.k, self.kept = k, np.full((asks, k), -np.inf)

    def taken(self, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``values`` (rows, asks), -inf for none -> ask and its rows that may be among the best."""
        floor = self.kept.min(axis=1)
        for q in np.flatnonzero((values > -np.inf).any(axis=0)).tolist():
            own = values[:, q]
            at = np.flatnonzero((own > -np.inf) & (own >= floor[q] - 1e-9))
            if not len(at):
                continue
            both = np.concatenate([self.kept[q], own[at]])
            self.kept[q] = np.partition(both, len(both) - self.k)[-self.k :]
            yield q, at[own[at] >= self.kept[q].min() - 1e-9]  # the nearly equal are told apart by id later


class _Ranked:
    """The k best rows of each of many asks so far: larger values (rounded to nine places) first, ties to the smaller id."""

    def __init__(self, asks: int, k: int, ids: pa.DataType):
        self.k, self.value, self.at, self.ids, self.base = k, np.full((asks, k), -np.inf), np.full((asks, k), -1), pa.array([], ids), 0

    def begin(self, ids: pa.Array) -> None:
        """The ids of the rows that :meth:`add` is told of next."""
        if len(self.ids) > 2 * self.at.size + (1 << 16):  # most are of rows that are no longer among the best
            left, new = np.unique(self.at, return_inverse=True)
            none = int((left < 0).any())
            self.ids, self.at = self.ids.take(pa.array(left[none:])), new.reshape(self.at.shape) - none
        self.base, self.ids = len(self.ids), pa.concat_arrays([self.ids, ids])

    def add(self, first: int, values: np.ndarray, rows: np.ndarray | None = None) -> None:
        """``values`` (rows, asks from ``first`` on), -inf for none; ``rows`` are their numbers in the ids."""
        if not values.size or not self.k:
            return
        kept, at = self.value[first : first + values.shape[1]], self.at[first : first + values.shape[1]]
        floor = np.maximum(kept[:, -1] - 2e-9, np.finfo(float).min)  # the nearly equal are told apart once rounded
        may = values >= floor
        if len(values) > self.k and np.count_nonzero(may) > 4 * self.k * values.shape[1]:
            may &= values >= np.partition(values, len(values) - self.k, axis=0)[len(values) - self.k] - 2e-9
        r, q = np.nonzero(may)
        if not len(r):
            return
        touched, own = np.unique(q, return_inverse=True)
        had = at[touched] >= 0
        of = np.concatenate([np.nonzero(had)[0], own])
        value = np.concatenate([kept[touched][had], values[r, q]])
        place = np.concatenate([at[touched][had], self.base + (r if rows is None else rows[r])])
        tie = pc.rank(self.ids.take(pa.array(place)), sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
        order = np.lexsort((tie, -np.round(value, 9), of))
        of = of[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        best = rank < self.k
        of, rank, order = touched[of[best]], rank[best], order[best]
        kept[of, rank], at[of, rank] = value[order], place[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ask, value and id of all that are kept."""
        q, k = np.nonzero(self.at >= 0)
        return q, self.value[q, k], self.ids.take(pa.array(self.at[q, k]))


def _sorting(keys: np.ndarray) -> np.ndarray:
    """The order of distinct keys, which are used up; numbers that hold their own place sort several times faster than places."""
    bits = max(len(keys) - 1, 1).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + bits > 63:
        return np.argsort(keys)
    keys <<= bits
    keys |= np.arange(len(keys))
    keys.sort()
    keys &= (1 << bits) - 1
    return keys


class _Block:
    """The weights ``w`` of phrases ``of`` in rows ``r`` of a block of chunks, as they are and in whole quanta, by phrase: a vector
    over all rows for each phrase that many rows have, else its rows.  ``kinds`` (keys, asks) and ``keys`` (of each row) are those
    that filters allow."""

    def __init__(self, phrases: _Phrases, rows: int, r: np.ndarray, of: np.ndarray, w: np.ndarray, kinds: np.ndarray | None = None, keys: np.ndarray | None = None):
        self.phrases, self.rows, self.kinds, self.keys = phrases, rows, kinds, keys
        if (r[1:] < r[:-1]).any():
            order = np.argsort(r, kind="stable")
            r, of, w = r[order], of[order], w[order]
        self.of, self.w, self.start = of, w, np.searchsorted(r, np.arange(rows + 1)).tolist()
        order = _sorting(of.astype(np.int64) * rows + r)
        place, value = r[order], w.astype(np.float32)[order]
        self.n = np.bincount(of, minlength=phrases.size)
        end = np.cumsum(self.n)
        most = np.zeros(phrases.size, np.float32)
        most[self.n > 0] = np.maximum.reduceat(value, (end - self.n)[self.n > 0]) if len(value) else 0
        sums = [np.bincount(phrases.ask_of(a, b), weights=most[phrases.codes(a, b)]).max(initial=0) for a, b in phrases.parts(1 << 16)]
        longest = int(phrases.n.max(initial=0))
        self.kind = np.uint16 if longest < 1 << 14 else np.uint32  # what holds any ask's sum
        self.quantum = max([*sums, 1e-30]) * 1.0001 / (np.iinfo(self.kind).max - longest)
        value = np.maximum(value / np.float32(self.quantum), 1).astype(self.kind)
        wide = np.flatnonzero(self.n > max(rows, 1) / 16)
        wide = wide[np.argsort(-self.n[wide], kind="stable")][:WIDE]
        self.column = np.full(phrases.size, -1, np.int32)
        self.column[wide] = np.arange(len(wide))
        table = np.zeros((len(wide), rows), self.kind)
        for k, p in enumerate(wide.tolist()):
            here = slice(end[p] - self.n[p], end[p])
            table[k, place[here]] = value[here]
        self.table = list(table)
        spans = [(e - n, e) for e, n in zip(end.tolist(), self.n.tolist(), strict=True)]
        self.places, self.values = [place[a:b] if a < b else None for a, b in spans], [value[a:b] if a < b else None for a, b in spans]

    def sums(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each ask that any chunk may answer, and the scores of all rows in quanta (one array, used again): above zero where a row has
        any phrase, and off by less than a quantum for each phrase of the ask."""
        p, add = self.phrases, np.add
        scores = np.zeros(self.rows, self.kind)
        for first, last in p.parts(1024):
            code, ask, told = p.codes(first, last), p.ask_of(first, last), []
            column = self.column[code]
            for mine, number in ((column >= 0, column), ((column < 0) & (self.n[code] > 0), code)):
                told.append((number[mine].tolist(), np.cumsum(np.bincount(ask[mine], minlength=last - first)).tolist()))
            (wide, wide_end), (few, few_end) = told
            a = b = 0
            for q in range(last - first):
                at, a = wide[a : wide_end[q]], wide_end[q]
                some, b = few[b : few_end[q]], few_end[q]
                if not at and not some:
                    continue
                if self.kinds is not None and not self.kinds[:, first + q].any():
                    continue
                if at:
                    np.copyto(scores, self.table[at[0]])
                    for c in at[1:]:
                        add(scores, self.table[c], scores)
                else:
                    scores.fill(0)
                if some:
                    add.at(scores, np.concatenate([self.places[c] for c in some]), np.concatenate([self.values[c] for c in some]))
                if self.kinds is not None and not self.kinds[:, first + q].all():
                    scores[~self.kinds[self.keys, first + q]] = 0
                yield first + q, scores

    def scores(self, asks: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Of pairs of ask and row, in the order of rows, as they are."""
        p, n = self.phrases, self.phrases.n[asks]
        end = np.cumsum(n)
        code = p.code[np.repeat(p.start[asks] - end + n, n) + np.arange(end[-1])]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        ends = [*(end - n)[first].tolist(), int(end[-1])]
        weights, found = np.zeros(p.size), np.empty(len(code))
        for row, a, b in zip(r[first].tolist(), ends, ends[1:], strict=False):
            of = self.of[self.start[row] : self.start[row + 1]]
            weights[of] = self.w[self.start[row] : self.start[row + 1]]
            found[a:b] = weights[code[a:b]]
            weights[of] = 0
        return np.bincount(np.repeat(np.arange(len(r)), n), weights=found, minlength=len(r))


class _Kept:
    """The k best chunks of each of many asks so far: larger scores (rounded to nine places) first, ties to the smaller id.
    ``floor``: scores of which it is known that k chunks reach them."""

    def __init__(self, phrases: _Phrases, k: int, floor: np.ndarray):
        self.phrases, self.k, self.floor = phrases, k, floor.copy()
        self.parts: list = []
        self.held = 0

    def meet(self, block: _Block, ids: pa.Array) -> None:
        """Scores in quanta tell which chunks may be among the best; these are scored as they are."""
        if not self.k or not len(block.of):
            return
        n = self.phrases.n
        least = np.clip(np.floor((self.floor - 2e-9) / block.quantum) - n - 1, 1, np.iinfo(block.kind).max).astype(block.kind)
        spare, reached = (2 * n + 3 + int(4e-9 / block.quantum)).tolist(), np.zeros(-(-block.rows // 8) * 8, bool)
        words, eights, own = reached.view(np.uint64), reached.reshape(-1, 8), reached[: block.rows]
        asks, rows, many = [], [], 0
        for q, scores in block.sums():
            np.greater_equal(scores, least[q], own)
            some = words.nonzero()[0]  # mostly a few
            if not len(some):
                continue
            if 8 * len(some) > 16 * self.k and block.rows > self.k:
                enough = int(np.partition(scores, block.rows - self.k)[block.rows - self.k]) - spare[q]
                if enough > least[q]:
                    np.greater_equal(scores, block.kind(enough), own)
                    some = words.nonzero()[0]
            at, k = eights[some].nonzero()
            at = some[at] * 8 + k
            asks.append(q)
            rows.append(at)
            many += len(at)
            if many >= PAIRS:
                self._add(block, ids, asks, rows)
                asks, rows, many = [], [], 0
        if many:
            self._add(block, ids, asks, rows)

    def _add(self, block: _Block, ids: pa.Array, asks: list[int], rows: list[np.ndarray]) -> None:
        q, r = np.repeat(asks, [len(x) for x in rows]), np.concatenate(rows)
        by_row = np.argsort(r, kind="stable")
        for at in range(0, len(r), 1 << 15):
            order = by_row[at : at + (1 << 15)]
            asks, mine = q[order], r[order]
            value = block.scores(asks, mine)
            good = (value > 0) & (value >= self.floor[asks] - 2e-9)
            self.parts.append((asks[good].astype(np.int32), value[good], ids.take(pa.array(mine[good]))))
            self.held += len(self.parts[-1][0])
            if self.held > self.k * self.phrases.asks + (1 << 16):
                self._cut()

    def _cut(self) -> None:
        q, value, ids = np.concatenate([x[0] for x in self.parts]), np.concatenate([x[1] for x in self.parts]), pa.concat_arrays([x[2] for x in self.parts])
        tie = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
        order = np.lexsort((tie, -np.round(value, 9), q))
        own = q[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        order, last = order[rank < self.k], order[rank == self.k - 1]
        self.floor[q[last]] = np.maximum(self.floor[q[last]], value[last] - 2e-9)
        self.parts, self.held = [(q[order], value[order], ids.take(pa.array(order)))], len(order)

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """Ask, score and id of all that are kept."""
        if self.parts:
            self._cut()
        return self.parts[0] if self.parts else None


def _slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that can be ranked, and their vectors."""
    n, x, good = units(vectors)
    at = np.flatnonzero(good & (n == dim))
    start = np.cumsum(n) - n
    return at, x[start[at][:, None] + np.arange(dim)] if len(at) else np.zeros((0, dim))


def dense_lists(queries: DataFrame, vectors: DataFrame, k: int, groups: tuple[str, ...]) -> DataFrame:
    """``queries(qid, q)``, one block of them, and ``vectors(id, v, *groups)`` -> qid, *groups, id, distance, where
    the ``k`` best of each query and group are among the rows."""
    asked = queries.toArrow()
    n, x, good = units(asked.column("q").combine_chunks())
    kinds = {c: f"{c} {vectors.schema[c].dataType.simpleString()}" for c in (*groups, "id")}
    if not good.any():
        return vectors.sparkSession.createDataFrame([], ", ".join([f"qid {queries.schema['qid'].dataType.simpleString()}", *kinds.values(), "distance double"]))
    start, sizes = np.cumsum(n) - n, sorted(set(n[good].tolist()))
    blocks = [(d, np.flatnonzero(good & (n == d))) for d in sizes]
    shared = vectors.sparkSession.sparkContext.broadcast((asked.column("qid").combine_chunks(), [(d, at, x[start[at][:, None] + np.arange(d)]) for d, at in blocks]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, own = shared.value
        best: dict = {}
        for part in _slices(batches):
            keys = list(zip(*[part.column(g).to_pylist() for g in groups], strict=True)) if groups else [()] * part.num_rows
            for d, asks, q in own:
                at, v = _matrix(part.column("v"), d)
                if not len(at):
                    continue
                near = v @ q.T
                of: dict = {}
                for r, i in enumerate(at.tolist()):
                    of.setdefault(keys[i], []).append(r)
                for key, mine in of.items():
                    mine = np.array(mine)
                    taken = [(a, r) for a, r in best.setdefault((d, key), _Best(len(asks), k)).taken(near[mine])]
                    if not taken:
                        continue
                    a, r = np.concatenate([np.full(len(r), a) for a, r in taken]), np.concatenate([mine[r] for _, r in taken])
                    rows = pa.array(at[r])
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(asks[a])), *[part.column(g).take(rows) for g in groups], part.column("id").take(rows), pa.array(1 - near[r, a])], ["qid", *groups, "id", "distance"])

    schema = ", ".join([f"qid {queries.schema['qid'].dataType.simpleString()}", *kinds.values(), "distance double"])
    return vectors.select("id", "v", *groups).mapInArrow(score, schema)


FILTERS = ("ticker", "year", "section")


def lists(store: DataFrame, asks: DataFrame, dense: int = CANDIDATES, keyword: int = CANDIDATES) -> DataFrame:
    """``asks(ask, phrases array<array<string>>[, q array<float>, ticker, years, sections])`` against the
    rows of a store -> ask, dense (whether of the dense list), id, value (distance or score), rank."""
    have, made = asks.columns, None
    whole = asks.select("ask", "phrases", *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("q", "array<float>"), ("ticker", "string"), ("years", "array<string>"), ("sections", "array<string>"))])
    n, size = whole.agg(F.count("*"), F.coalesce(F.sum(F.size("phrases")), F.lit(0))).first()
    only_words = not any(c in have for c in ("q", "ticker", "years", "sections"))
    blocks = max(-(-n // (SCAN_WORDS if only_words else SCAN)), -(-size // (32 * SCAN_WORDS))) if n else 0
    for b in range(blocks):
        own = whole if blocks == 1 else whole.where(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == b)
        found = _lists(store, own.toArrow(), whole.schema["ask"].dataType.simpleString(), dense, keyword)
        made = found if made is None else made.unionByName(found)
    if made is None:
        return store.sparkSession.createDataFrame([], f"ask {whole.schema['ask'].dataType.simpleString()}, dense boolean, id {store.schema['id'].dataType.simpleString()}, value double, rank int")
    order = Window.partitionBy("ask", "dense").orderBy(F.desc("key"), "id")
    ranked = made.withColumn("rank", F.row_number().over(order)).drop("key")
    return ranked.where(F.col("rank") <= F.when(F.col("dense"), dense).otherwise(keyword)).where(F.col("rank") <= max(dense, keyword))


def _lists(store: DataFrame, asked: pa.Table, kind: str, dense: int, keyword: int) -> DataFrame:
    phrases, names = _Phrases(asked.column("phrases").combine_chunks()), asked.column("ask").combine_chunks()
    given = [c for c in ("ticker", "years", "sections") if asked.column(c).null_count < len(asked)]
    asks = asked.select(["ticker", "years", "sections"]).to_pylist() if given else []
    context = store.sparkSession.sparkContext
    shared = context.broadcast(phrases)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, df, n, size = shared.value, np.zeros(shared.value.size, np.int64), 0, 0
        for part in _slices(batches, 4 * ROWS):
            df += np.bincount(p.hits(part)[1], minlength=len(df))
            n, size = n + part.num_rows, size + pc.sum(part.column("dl")).as_py()
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2]), pa.array([*df[at].tolist(), n, size])], ["phrase", "n"])

    counted = store.select("dl", *phrases.columns()).mapInArrow(count, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n")).toArrow()
    told = np.zeros(phrases.size + 2)
    told[counted.column("phrase").to_numpy()] = counted.column("n").to_numpy()  # the last two: -2 and -1
    df, n, mean = told[:-2], int(told[-1]), max(told[-2], 1) / max(told[-1], 1)
    weights = np.maximum(IDF_FLOOR, np.log((n - df + 0.5) / (df + 0.5)))
    given = asked.column("q").combine_chunks()
    fits = np.flatnonzero(pc.fill_null(pc.list_value_length(given), 0).to_numpy(zero_copy_only=False))
    size, x, good = units(given.take(pa.array(fits)))
    fits, dim = fits[good], int(size.max(initial=0))
    vectors = x.reshape(-1, dim)[good] if dim else np.zeros((0, 0))
    filters = [c for c in FILTERS if c in store.columns and any(a[{"ticker": "ticker", "year": "years", "section": "sections"}[c]] for a in asks)]
    told_filters = context.broadcast(asks if filters else None)

    def allowed(asks: list[dict], key: tuple) -> np.ndarray:
        told = dict(zip(filters, key, strict=True))
        ticker, year, section = (told.get(c) for c in FILTERS)
        return np.array([(not a["ticker"] or a["ticker"] == ticker) and (not a["years"] or year in a["years"]) and (not a["sections"] or section in a["sections"]) for a in asks], bool)

    def keyed(parts: list[pa.RecordBatch], known: dict) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Which asks the filters let meet each combination of keys, and the number of each row's."""
        if not filters:
            return None, None
        own = [key for part in parts for key in zip(*[part.column(c).to_pylist() for c in filters], strict=True)]
        number = {key: k for k, key in enumerate(dict.fromkeys(own))}
        for key in number:
            if key not in known:
                known[key] = allowed(told_filters.value, key)
        return np.stack([known[key] for key in number]), np.array([number[key] for key in own])

    def blocks(batches: Iterator[pa.RecordBatch], known: dict, rows: int, most: int, seen=lambda part: None) -> Iterator[tuple[_Block, pa.Array]]:
        """Blocks of ``most`` rows, or as many as have ``HITS`` hits, and their ids; ``seen`` is told of each part of ``rows``."""
        p, parts, hits, n, many = shared.value, [], [], 0, 0

        def made() -> tuple[_Block, pa.Array]:
            r, of, w = (np.concatenate(x) for x in zip(*hits, strict=True))
            hits.clear()
            keys = [part.select([*filters, "id"]) for part in parts]
            return _Block(p, n, r, of, w, *keyed(keys, known)), pa.concat_arrays([part.column("id") for part in keys])

        for part in _slices(batches, rows):
            seen(part)
            r, of, f = p.hits(part)
            dl = part.column("dl").to_numpy(zero_copy_only=False)[r]
            hits.append((r + np.int32(n), of, weights[of] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))))
            parts.append(part.select([*filters, "id"]))
            n, many = n + part.num_rows, many + len(r)
            if n >= most or many >= HITS:
                yield made()
                parts, hits, n, many = [], [], 0, 0
        if parts:
            yield made()

    floor = np.zeros(phrases.asks)
    if keyword and n * phrases.asks >= FLOORS:
        few = max(2, round(math.sqrt(n / 6_000)))  # fewer asked first leave more to pass on

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for block, _ in blocks(batches, {}, 2 * ROWS, 8 * ROWS):
                found = []
                for q, scores in block.sums():
                    own = scores if len(scores) <= keyword else np.partition(scores, len(scores) - keyword)[len(scores) - keyword :]
                    own = (own.astype(float) - int(p.n[q]) - 1) * block.quantum  # or more
                    found.append((q, own[own > 0]))
                    if len(found) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found]), pa.array([x for _, x in found], pa.list_(pa.float64()))], ["ask", "best"])
                        found = []
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.float64()))], ["ask", "best"])

        some = store.where(F.pmod(F.xxhash64("id"), F.lit(few)) == 0).select("id", "dl", *phrases.columns(), *filters)
        tasks = max(-(-n // (few * 8 * ROWS)), min(context.defaultParallelism, -(-n // (few * ROWS))))
        found = some.repartition(tasks, "id").mapInArrow(best, "ask long, best array<double>")
        reached = found.groupBy("ask").agg(F.get(F.sort_array(F.flatten(F.collect_list("best")), False), F.lit(keyword - 1)).alias("floor")).where("floor IS NOT NULL").toArrow()
        floor[reached.column("ask").to_numpy()] = reached.column("floor").to_numpy()
    sent = context.broadcast((names, floor, fits, vectors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, (names, floor, fits, vectors) = shared.value, sent.value
        known: dict = {}
        kept, near = _Kept(p, keyword, floor), None

        def close_to(part: pa.RecordBatch) -> None:
            nonlocal near
            near = near or _Ranked(len(fits), dense, part.column("id").type)
            kinds, keys = keyed([part], known)
            at, v = _matrix(part.column("v"), vectors.shape[1])
            near.begin(part.column("id"))
            for first in range(0, len(fits) if len(at) else 0, BLOCK):
                close = v @ vectors[first : first + BLOCK].T - 1
                if filters:
                    close[~kinds[:, fits[first : first + BLOCK]][keys[at]]] = -np.inf
                near.add(first, close, at)

        by_vector = bool(dense and len(fits))
        for block, ids in blocks(batches, known, ROWS if by_vector else 4 * ROWS, 16 * ROWS, close_to if by_vector else lambda part: None):
            kept.meet(block, ids)
        for of_dense, found in ((False, kept.rows()), (True, near.rows() if near else None)):
            if found is not None:
                q, value, ids = found
                ask = names.take(pa.array(fits[q] if of_dense else q))
                for at in range(0, len(q), 1 << 16):
                    here = slice(at, at + (1 << 16))
                    own = value[here]
                    yield pa.RecordBatch.from_arrays([ask[here], pa.array(np.full(len(own), of_dense)), ids[here], pa.array(-own if of_dense else own), pa.array(np.round(own, 9))], ["ask", "dense", "id", "value", "key"])

    own = store.select("id", "dl", *phrases.columns(), *filters, *(["v"] if dense and len(fits) else []))
    if n * phrases.asks >= FLOORS:  # a task spends time on each ask, however few chunks it has
        own = own.coalesce(max(context.defaultParallelism, -(-n // (9 * ROWS))))
    return own.mapInArrow(score, f"ask {kind}, dense boolean, id {store.schema['id'].dataType.simpleString()}, value double, key double")
