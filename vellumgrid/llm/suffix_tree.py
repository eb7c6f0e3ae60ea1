"""Language-model scoring with a probabilistic suffix tree over words.

Tokens are whitespace-separated words (A-Z lower-cased), then one end token.

* Root: add-one unigram over all training tokens.
* Contexts grow by a word in front, up to ``depth`` words.  One is a candidate if it occurs
  ``context`` times or more in the training texts and its parent, it without its first word, is
  retained; its next symbols are those that follow it ``joint`` times or more.  Both numbers are
  absolute, so the tree grows with the corpus.
* Divergence test: a next symbol w of a context s is retained if c(s,w) times the absolute
  log ratio of c(s,w)/C(s) to the parent's probability of w exceeds ``divergence`` nats.  A context is
  retained if one of its symbols is.
* P(w|s) = (kept(s,w) + rest(s) * P(w|parent)) / (C(s) + strength) with kept = c less
  ``discount`` for a retained symbol and else 0, rest(s) = C(s) + strength - sum of kept(s,.),
  which sums to one.
* A token is scored in the longest retained suffix of what precedes it.  Along the
  suffixes of a place, log P grows by log(rest(s) / (C(s) + strength)) at each retained context, and
  by a further amount where its symbol is retained.  So a text's score is its unigram score
  and the sum, over all its runs of 1 to depth + 1 words, of one value that belongs to the run.

Nothing that grows with the corpus is collected or broadcast.  Runs are counted order by order in
shuffles, and a run is counted only if its two parts one word shorter may qualify, which a bitmap of
fixed size tells (it may say yes too often, which costs work only).  The tree is a table
(run, value).  Counts of tokens with a relative frequency of ``frequent`` or more (at most
1/frequent of them), and values of such runs (so many of each length at most), reach the scorers by
broadcast; all others meet their documents in a shuffled join, in which no key is frequent.

Tokens and runs are known by 64-bit hashes, polynomials of the bytes and of the tokens' hashes; of a
billion of them, two share one with a probability of 3 %, which then count as one.

Defined cases: null text counts as empty (only the end token); no training rows:
N = V = 0 and every token has the root's probability 1; repeated rows, also with one
doc_id, are scored row by row; rows with a null doc_id count as training rows; other columns are
not looked at.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, cut, release, stored

#: Run keys are polynomials of token hashes in this odd number, modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
#: Token hashes are polynomials of numbers that stand for bytes, in this one.
BYTE_BASE = 0xD1342543DE82EF95
BITS = 26  # of a bitmap's positions: 8 MB
RANK = 21  # bits of a rank in the lexicon
END = 0x2545F4914F6CDD1D  # the end token's hash; it has no bytes
PIECE = 1 << 20  # bytes of text that are worked on at a time


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: of each byte; A-Z stand for a-z
LETTERS = _mixed(np.arange(1, 257, dtype=np.uint64))
LETTERS[65:91] = LETTERS[97:123]
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@functools.cache
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass(frozen=True)
class Settings:
    depth: int = 4  # words of the longest context
    context: int = 64  # occurrences of a context
    joint: int = 8  # occurrences of a context with its next symbol
    divergence: float = 10.0
    strength: float = 4.0
    discount: float = 0.75
    frequent: float = 1e-6  # of tokens, and runs, that are broadcast


def tokens(text: str | None) -> list[bytes]:
    """The plain form of what :func:`_pieces` does in bulk."""
    return [*(text.encode("utf-8", "surrogatepass").lower().split() if text else []), b""]


def _hashes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of the tokens data[begin:stop].  All bytes are worked on at once: with P the running sum of
    letter(byte j) * BYTE_BASE ** j, a token's hash is its part of P over BYTE_BASE ** begin."""
    out, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        low = begin[at]
        to = max(at + 1, int(np.searchsorted(stop, low + PIECE, side="right")))
        size = int(stop[to - 1] - low)
        powers = [_powers(PIECE + 1, b) if size <= PIECE else _powers.__wrapped__(size + 1, b) for b in (BYTE_BASE, pow(BYTE_BASE, -1, 1 << 64))]
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(LETTERS[data[low : low + size]] * powers[0][:size], out=sums[1:])
        b, e = begin[at:to] - low, stop[at:to] - low
        out[at:to] = _mixed((sums[e] - sums[b]) * powers[1][b])
        at = to
    return out


class Table:
    """Finds 64-bit keys that are spread evenly: the first bits tell where to look."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(np.sort(keys), np.uint64(2**64 - 1))  # a guard that ends every search
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key in ascending order, -1 if there is none."""
        at = self.first[keys >> np.uint64(44)]
        left = np.flatnonzero(self.keys[at] < keys)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < keys[left]]
        return np.where((self.keys[at] == keys) & (at < len(self.keys) - 1), at, -1)


class Lexicon:
    """The most frequent tokens; a token's rank is its number in the order of hashes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.table = hashes[order], counts[order], Table(hashes)


@dataclass
class Piece:
    """The tokens of some texts one after the other: hash, rank in the lexicon (-1: none; not there
    without a lexicon), number of the text, and place in it."""

    hashes: np.ndarray
    ranks: np.ndarray | None
    text: np.ndarray
    place: np.ndarray
    batch: pa.RecordBatch


def _pieces(batches: Iterator[pa.RecordBatch], lexicon: Lexicon | None) -> Iterator[Piece]:
    for batch in batches:
        for part in by_size(batch, most=PIECE):
            texts = pc.fill_null(part.column("text"), "").cast(pa.string())
            edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
            edges = edges - edges[0]
            space = np.ones(len(data) + 2, bool)  # and one before and one after
            space[1:-1] = SPACES[data]
            new = np.zeros(len(data) + 1, bool)  # where a text begins or ends
            new[edges] = True
            word = ~space[1:-1]
            begin = np.flatnonzero(word & (space[:-2] | new[:-1]))
            stop = np.flatnonzero(word & (space[2:] | new[1:])) + 1
            n = np.diff(np.searchsorted(begin, edges)) + 1  # with the end token
            text = np.repeat(np.arange(len(n), dtype=np.int32), n)
            starts = np.cumsum(n) - n
            place = (np.arange(len(text)) - starts[text]).astype(np.int32)
            hashes = np.full(len(text), END, np.uint64)
            real = np.ones(len(text), bool)
            real[starts + n - 1] = False
            hashes[real] = _hashes(data, begin, stop)
            yield Piece(hashes, None if lexicon is None else lexicon.table.find(hashes), text, place, part)


def _runs(piece: Piece, order: int) -> np.ndarray:
    """The key of the run of ``order`` tokens that ends at each place (meaningless where it would
    begin before the text)."""
    keys = piece.hashes.copy()
    for _ in range(order - 1):
        keys[1:] = keys[:-1] * np.uint64(BASE) + piece.hashes[1:]
    return keys


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (held,) in _batched((p.hashes,) for p in _pieces(batches, None)):
        keys, n = np.unique(held, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "c"])


def _batched(parts: Iterator[tuple[np.ndarray, ...]], most: int = 2_000_000) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += max(map(len, part))
        if n >= most:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n, part = [], 0, None  # before it is used, so that nothing is held twice
            yield [whole.pop(0) for _ in list(whole)]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bit for each position that one of ``keys(key)`` has; at most 2 ** 20 words of 64 bits."""
    at = F.col("key").bitwiseAND(F.lit((1 << BITS) - 1))
    word, bit = F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    got = keys.select(word.cast("int").alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def _may(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64((1 << BITS) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _top(rows: DataFrame, least: float) -> tuple[pa.Table, DataFrame]:
    """The rows of ``rows(key, c, ...)`` of that count or more, and the others."""
    return rows.where(F.col("c") >= least).toArrow(), rows.where(F.col("c") < least)


@dataclass
class Fitted:
    counts: DataFrame  # key, c: every training token
    n: int
    v: int
    lexicon: Lexicon
    rest: DataFrame  # the tokens that the lexicon has not
    values: DataFrame  # key, v, c: the tree
    levels: list[DataFrame]  # per order from 2: key, c, p, v
    settings: Settings


def fit(train: DataFrame, settings: Settings = Settings()) -> Fitted:
    """Count over all of ``train(text)``."""
    s, spark = settings, train.sparkSession
    train = train.select("text")
    counts = cut(train.mapInArrow(_count_tokens, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top, rest = _top(counts, max(s.frequent, 2.0 ** (1 - RANK)) * n)
    lexicon = Lexicon(top.column("key").to_numpy().view(np.uint64), top.column("c").to_numpy())
    shared = spark.sparkContext.broadcast(lexicon)
    whole = float(n + v + 1)
    known = counts.select("key", "c", ((F.col("c") + 1) / F.lit(whole)).alias("p"))
    levels, values = [], None
    contexts = known.where(F.col("c") >= s.context)
    for order in range(2, s.depth + 2):
        maps = spark.sparkContext.broadcast((_bitmap(contexts), _bitmap(known.where(F.col("c") >= s.joint))))
        rows = stored(_counted(train, order, shared, maps, whole if order == 2 else None, s), "runs")
        level, own, contexts = _tested(rows, contexts, known, s)
        release(rows)
        if own is None:
            break
        levels.append(level)
        values = own if values is None else values.unionByName(own)
        known = level
    if values is None:
        values = known.select("key", F.lit(0.0).alias("v"), "c").limit(0)
    # a run may be a context and a context with its symbol
    values = cut(values.groupBy("key").agg(F.sum("v").alias("v"), F.max("c").alias("c")))
    return Fitted(counts, n, v, lexicon, rest, values, levels, s)


def _counted(train: DataFrame, order: int, lexicon, bitmaps, whole: float | None, s: Settings) -> DataFrame:
    """Runs of ``order`` tokens with a count of ``joint`` or more, of which the first part may be a context
    and the last part a run so frequent: key, prefix, suffix, c, and for order 2 total (count of the
    context) and parent (root probability) of tokens that the lexicon has.

    A row on its way is a key with the codes of its first and last token (rank in the lexicon or hash), from which
    the parts' keys follow.  Two ranks are packed in one number, for order 2 in the key."""
    code = lambda rank, p, at: np.where(rank >= 0, rank, p.hashes[at].view(np.int64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, symbol = bitmaps.value

        def parts():
            for p in _pieces(batches, lexicon.value):
                shorter = _runs(p, order - 1)
                ok = np.zeros(len(shorter), bool)
                ok[1:] = (p.place[1:] >= order - 1) & _may(context, shorter[:-1]) & _may(symbol, shorter[1:])
                at = np.flatnonzero(ok)
                first, last = p.ranks[at - order + 1], p.ranks[at]
                both = (first >= 0) & (last >= 0)
                pairs = first.astype(np.int64) << RANK | last
                if order == 2:
                    yield pairs[both], *(x[~both] for x in (shorter[at - 1] * np.uint64(BASE) + p.hashes[at], code(first, p, at - 1), code(last, p, at), both))
                else:
                    yield at[:0], shorter[at - 1] * np.uint64(BASE) + p.hashes[at], np.where(both, pairs, code(first, p, at - order + 1)), code(last, p, at), both

        for pairs, keys, first, last, both in _batched(parts(), 4_000_000 if order == 2 else 2_000_000):
            pairs, n = np.unique(pairs, return_counts=True)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(pairs), none, none, pa.array(n)], ["key", "first", "last", "c"])
            keys, at, n = np.unique(keys, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(first[at]), pa.array(last[at], mask=both[at]), pa.array(n)], ["key", "first", "last", "c"])

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for batch in batches:
            keys, c = batch.column("key").to_numpy(), batch.column("c").to_numpy()
            packed = batch.column("last").is_null().to_numpy(zero_copy_only=False)
            given = [pc.fill_null(batch.column(x), 0).to_numpy(zero_copy_only=False) for x in ("first", "last")]
            pairs = keys if order == 2 else given[0]
            ends = [np.where(packed, pairs >> RANK, given[0]), np.where(packed, pairs & ((1 << RANK) - 1), given[1])]
            ranked = [(e >= 0) & (e < len(lex.hashes)) for e in ends]
            first, last = (np.where(r, lex.hashes[np.where(r, e, 0)] if len(lex.hashes) else 0, e.view(np.uint64)) for e, r in zip(ends, ranked, strict=True))
            if order == 2:
                prefix, suffix = first, last
                key = first * np.uint64(BASE) + last
                seen = [lex.counts[np.where(r, e, 0)] for e, r in zip(ends, ranked, strict=True)] if len(lex.hashes) else [c, c]
                told = [pa.array(seen[0].astype(np.int64), mask=~ranked[0]), pa.array((seen[1] + 1) / whole, mask=~ranked[1])]
            else:
                key = keys.view(np.uint64)
                prefix = (key - last) * np.uint64(pow(BASE, -1, 1 << 64))
                suffix = key - first * np.uint64(pow(BASE, order - 1, 1 << 64))
                told = [pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.float64())]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (key, prefix, suffix)), pa.array(c), *told], ["key", "prefix", "suffix", "c", "total", "parent"])

    rows = train.mapInArrow(counted, "key long, first long, last long, c long").groupBy("key", "first", "last").agg(F.sum("c").alias("c"))
    return rows.where(F.col("c") >= s.joint).mapInArrow(parted, "key long, prefix long, suffix long, c long, total long, parent double")


def _tested(rows: DataFrame, contexts: DataFrame, known: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The divergence test over ``rows`` of one order; ``known(key, c, p)`` is the order below and
    ``contexts(key, c)`` the candidates in it.  Returns key, c, p (the probability of the last token after the
    others), the order's values, and the candidates of the next order."""
    told = rows.where(F.col("total").isNotNull() & F.col("parent").isNotNull())
    other = rows.where(F.col("total").isNull() | F.col("parent").isNull()).drop("total", "parent")
    other = other.join(contexts.select(F.col("key").alias("prefix"), F.col("c").alias("total")), "prefix").join(known.select(F.col("key").alias("suffix"), F.col("p").alias("parent")), "suffix")
    rows = told.unionByName(other).where(F.col("total") >= s.context)
    kept = F.col("c") * F.abs(F.log(F.col("c") / F.col("total") / F.col("parent"))) > s.divergence
    rows = stored(rows.select("key", "prefix", "suffix", "c", "total", "parent", kept.alias("kept")), "tested")
    sums = rows.where("kept").groupBy("prefix").agg((F.max("total") + s.strength).alias("whole"), F.sum(F.col("c") - s.discount).alias("kept_sum"))
    sums = cut(sums.select("prefix", "whole", (F.col("whole") - F.col("kept_sum")).alias("rest")))
    if not sums.limit(1).count():
        return rows, None, None
    rest = F.col("rest") * F.col("parent")
    p = F.when(F.col("whole").isNull(), F.col("parent")).otherwise((F.when(F.col("kept"), F.col("c") - s.discount).otherwise(0.0) + rest) / F.col("whole"))
    level = rows.join(sums, "prefix", "left").select("key", "suffix", "c", p.alias("p"), F.when(F.col("kept"), F.log10(p / rest * F.col("whole"))).alias("v"))
    level = stored(level, "level")
    release(rows)
    told = sums.select(F.col("prefix").alias("key"), F.log10(F.col("rest") / F.col("whole")).alias("v"), (F.col("whole") - s.strength).cast("long").alias("c"))
    grown = level.where(F.col("c") >= s.context).join(sums.select(F.col("prefix").alias("suffix")), "suffix", "left_semi").select("key", "c")
    return level.select("key", "c", "p"), level.where(F.col("v").isNotNull()).select("key", "v", "c").unionByName(told), grown


def score(docs: DataFrame, model: Fitted) -> DataFrame:
    """Per row of ``docs(doc_id, held_out, text)``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score."""
    s, spark = model.settings, docs.sparkSession
    whole = float(model.n + model.v + 1)
    top, rest = _top(model.values, s.frequent * model.n)
    keys = top.column("key").to_numpy().view(np.uint64)
    beyond = _bitmap(rest)
    shared = spark.sparkContext.broadcast((model.lexicon, Table(keys), top.column("v").to_numpy()[np.argsort(keys)], beyond if beyond.any() else None))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lexicon, runs, values, more = shared.value
        task, row = TaskContext.get().partitionId(), 0
        logs = np.append(np.log10(lexicon.counts + 1.0), 0.0)
        for p in _pieces(batches, lexicon):
            n = p.batch.num_rows
            total = lambda weights, of=p.text, n=n: np.bincount(of, weights=weights, minlength=n)
            gain, asked, who = np.zeros(n), [p.hashes[p.ranks < 0]], [p.text[p.ranks < 0]]
            run, near = p.hashes.copy(), np.ones(len(p.hashes), bool)
            for k in range(1, s.depth + 2):
                if k > 1:
                    run[1:] = run[:-1] * np.uint64(BASE) + p.hashes[1:]
                    # a run has a value only if the run without its last token, or that without its first, has one
                    near[1:] |= near[:-1]
                live = np.flatnonzero(near & (p.place >= k - 1))
                at = runs.find(run[live])
                hit = at >= 0
                gain += np.bincount(p.text[live[hit]], weights=values[at[hit]], minlength=n)
                near = np.zeros(len(near), bool)
                near[live[hit]] = True
                if more is not None:
                    left = live[~hit]
                    left = left[_may(more, run[left])]
                    near[left] = True
                    if k == 1:  # rare tokens are asked for in any case
                        left = left[p.ranks[left] >= 0]
                    asked.append(run[left])
                    who.append(p.text[left])
            asked, who = np.concatenate(asked), np.concatenate(who)
            asked = asked[np.argsort(who, kind="stable")].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))]).astype(np.int32)
            rows = pa.array(np.arange(n) + (task << 40) + row)
            row += n
            yield pa.RecordBatch.from_arrays(
                [rows, p.batch.column("doc_id"), p.batch.column("held_out"), pa.array(total(None).astype(np.int64)), pa.array(total((p.ranks >= 0).astype(float)).astype(np.int64)), pa.array(total(logs[p.ranks])), pa.array(gain), pa.ListArray.from_arrays(pa.array(ends), pa.array(asked))],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "gain", "asked"],
            )

    kind = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, logs double, gain double, asked array<bigint>"
    rows = cut(docs.select("doc_id", "held_out", "text").mapInArrow(scored, kind))
    asked = rows.select("row", F.explode("asked").alias("key"))
    # an inner join: a token that training never saw adds log10(0 + 1) = 0 and is not known
    told = model.rest.select("key", F.lit(1).alias("known"), F.log10(F.col("c") + 1).alias("log"), F.lit(0.0).alias("v"))
    told = told.unionByName(rest.select("key", F.lit(0).alias("known"), F.lit(0.0).alias("log"), "v"))
    found = asked.join(told, "key").groupBy("row").agg(F.sum("known").alias("more"), F.sum("log").alias("more_logs"), F.sum("v").alias("more_gain"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = F.col("logs") + zero("more_logs") - F.col("n_tokens") * F.lit(math.log10(whole))
    return rows.drop("asked").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain") + zero("more_gain")).alias("score"),
    )
