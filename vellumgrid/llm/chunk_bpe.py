"""BPE encoding and decoding with chunks that documents share encoded once.

* Texts are cut into chunks where a rolling hash of the last 32 bytes has ``zeros`` zero bits, so the
  same passage is cut alike wherever it stands.
* A chunk that occurs more than once, in whatever documents, is shared.  Each shared chunk is encoded once,
  into a table by its 128-bit digest, and documents refer to it.
* What stands between shared chunks is encoded in place.
* Where a chunk ends inside a word, the join is repaired: the text around it, from a word before the
  cut word to a word after it, is encoded anew, and takes the place of the ids that the
  chunks have there.  The repair holds only if the new ids agree with the chunks' own ids at both ends of that
  text; if not, it is widened by a word on each side and encoded again, up to the text's ends.

The repaired ids are those of the whole text.  The vocabulary's normaliser (composition, lower case, white
space) and its pattern of words never reach over ASCII white space, nor do its special tokens, so encoding
may be split before such a character.  :class:`Codec` checks that the file is of that kind.  By the same rule it
keeps the ids of words that it has met, a bounded number of them.

Which chunks are shared is told by a bitmap of hashes (64 MB at most).  It may take one for shared that is
not, which costs a look-up.  Shared chunks travel once a task, references and ids to their document, and the
ids between them are packed and not stored on their way; documents without any reference are finished where they are read.

Defined cases: null text is empty (no ids); a special token's string in a text is that token, as in
the library; repeated rows, also with one doc_id, give a row each; rows with a null doc_id are encoded as all
others; an empty table gives no row; other columns are not looked at; a document's ids are held by one task.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import json
import sys
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Members, by_size, members, release, spread_join, stored

BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A number for each byte, which the rolling hash adds up.
GEAR = np.random.default_rng(12).integers(0, 1 << 32, 256, dtype=np.uint32)
WINDOW = 32


@dataclass(frozen=True)
class Settings:
    zeros: int = 9  # bits of the rolling hash: a chunk has about 2 ** zeros bytes beyond the least
    least: int = 128  # bytes of a chunk, but for a text's last one
    words: int = 1  # whole words on each side of a repaired one, at first
    memo: int = 300_000  # words whose ids a worker keeps, and as many of before
    part: int = 1 << 20  # bytes of text that are worked on at a time


class Codec:
    """The library's tokenizer for parts of texts that begin and end at ASCII white space or a text's end."""

    def __init__(self, path: str, memo: int = Settings.memo):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        kinds = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        if not set(kinds) <= {"NFC", "Replace", "Lowercase"} or told["pre_tokenizer"]["pretokenizers"][0]["behavior"] != "Removed" or any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in told["added_tokens"]):
            raise ValueError("the vocabulary's words may reach over white space")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.type = np.dtype("<u4" if self.wide else "<u2")
        self.folds = "Lowercase" in kinds
        # without a decoder the library joins the tokens by spaces
        tokens = None if told["decoder"] else [self.library.id_to_token(i) for i in range(self.library.get_vocab_size())]
        self.tokens = np.array([t.encode() for t in tokens], object) if tokens and None not in tokens else None
        self.memo, self.known, self.older = memo, {"": b""}, {}

    def _library(self, texts: list[str]) -> list[bytes]:
        if sys.byteorder == "big":
            return [np.array(e.ids, self.type).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [array("I" if self.wide else "H", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _base(self, word: str) -> str:
        """A word with the same ids; words of ASCII letters come to lower case anyhow."""
        return word.lower() if self.folds and word.isascii() and word.isalpha() else word

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not known.  A mark after an ASCII letter is a word of its own to the pattern."""
        cut = {w: (self._base(w[:-1]), w[-1]) if len(w) > 1 and w[-1] in ".,;:!?" and w[-2].isascii() and w[-2].isalpha() else (self._base(w),) for w in words}
        found, new = {}, set()
        for p in {p for parts in cut.values() for p in parts}:
            ids = self.known.get(p) or self.older.get(p)
            if ids is None:
                new.add(p)
            else:
                found[p] = ids
        new = list(new)
        found.update(zip(new, self._library(new), strict=True))
        got = {w: b"".join([found[p] for p in parts]) for w, parts in cut.items()}
        got.update(found)
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian."""
        lists = []
        for text in texts:
            for c in "\t\n\v\f\r":
                text = text.replace(c, " ")
            lists.append(text.split(" "))
        if len(self.known) > self.memo:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        new = set().union(*lists).difference(known)
        known.update([(w, older[w]) for w in new if w in older])
        rare = self._learn({w for w in new if w not in older})
        known.update([(w, ids) for w, ids in rare.items() if len(w) <= 64])
        long = {w: ids for w, ids in rare.items() if len(w) > 64}
        if long:
            return [b"".join([long[w] if w in long else known[w] for w in words]) for words in lists]
        return [b"".join(map(known.__getitem__, words)) for words in lists]

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.type)

    def decode(self, ids) -> str:
        return self.decoded(np.asarray(ids, np.int64)).decode()

    def decoded(self, ids: np.ndarray) -> bytes:
        """The library's text of the ids, in UTF-8."""
        if self.tokens is not None and (not len(ids) or 0 <= ids.min() and ids.max() < len(self.tokens)):
            return b" ".join(self.tokens[ids].tolist())
        return self._decode(ids).encode()

    def _decode(self, ids) -> str:
        return self.library.decode(ids.tolist() if isinstance(ids, np.ndarray) else list(ids), skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def codec(path: str, memo: int = Settings.memo) -> Codec:
    """Built once in each worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path, memo)


@functools.lru_cache(maxsize=1)
def packer():
    """zstd at its fastest, built once in each worker."""
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_checksum=False), zstandard.ZstdDecompressor()


def pack(ids: bytes) -> bytes:
    return packer()[0].compress(ids)


def unpack(raw: bytes) -> bytes:
    return packer()[1].decompress(raw)


def rolling(data: np.ndarray) -> np.ndarray:
    """Of each byte the hash of the ``WINDOW`` bytes that end with it."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


@dataclass
class Text:
    raw: bytes
    edges: list[int]  # where its chunks begin and end
    digests: list[bytes]
    row: int  # in the batch


@dataclass
class Piece:
    batch: pa.RecordBatch
    texts: list[Text]


def _chunked(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[Piece]:
    import xxhash

    for batch in batches:
        for part in by_size(batch, most=s.part):
            texts = pc.fill_null(part.column("text"), "").cast(pa.string())
            edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
            starts = (edges - edges[0]).tolist()
            # a cut stands before a byte that begins a character
            spots = (np.flatnonzero((rolling(data) >> np.uint32(32 - s.zeros) == 0)[:-1] & ((data[1:] & 0xC0) != 0x80)) + 1).tolist() if len(data) else []
            whole, made = data.tobytes(), []
            for row, (start, end) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                cuts, at = [start], bisect.bisect_left(spots, start + s.least)
                while at < len(spots) and spots[at] < end:
                    cuts.append(spots[at])
                    at = bisect.bisect_left(spots, spots[at] + s.least, at)
                if end > start:
                    cuts.append(end)
                digests = [xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                made.append(Text(whole[start:end], [c - start for c in cuts], digests, row))
            yield Piece(part, made)


def _keys(digests: list[bytes]) -> np.ndarray:
    """The 64-bit keys by which chunks are counted."""
    return np.frombuffer(b"".join(digests), "<u8")[::2]


def _shared(texts: list[Text], known: Members) -> list[np.ndarray]:
    flags = known.has(_keys([d for t in texts for d in t.digests])) if any(t.digests for t in texts) else np.zeros(0, bool)
    return np.split(flags, np.cumsum([len(t.digests) for t in texts])[:-1])


@dataclass
class Plan:
    """A document made of shared chunks and of text: ``spots`` are (begin, end, digest or None) in order,
    ``windows`` the parts that are encoded anew."""

    text: Text
    spots: list[tuple[int, int, bytes | None]]
    blanks: list[int]
    words: int
    windows: list[tuple[int, int]]

    def repaired(self) -> None:
        """Lay windows around the joins that are inside a word."""
        raw, self.windows = self.text.raw, []
        for _, p, _ in self.spots[:-1]:
            if BLANK[raw[p]] or BLANK[raw[p - 1]]:
                continue  # words end here
            lo, hi = self._before(p), self._after(p)
            for _ in range(self.words):
                lo, hi = self._before(max(lo - 1, 0)), self._after(min(hi + 1, len(raw)))
            if self.windows and lo <= self.windows[-1][1]:
                lo = min(lo, self.windows.pop()[0])
            self.windows.append((lo, hi))

    def _before(self, p: int) -> int:
        """Where the word that holds or ends at p begins; white space before p is passed over."""
        at = bisect.bisect_left(self.blanks, p)
        while at and self.blanks[at - 1] == p - 1:
            at, p = at - 1, p - 1
        return self.blanks[at - 1] + 1 if at else 0

    def _after(self, p: int) -> int:
        at = bisect.bisect_left(self.blanks, p)
        while at < len(self.blanks) and self.blanks[at] == p:
            at, p = at + 1, p + 1
        return self.blanks[at] if at < len(self.blanks) else len(self.text.raw)

    def asked(self) -> list[tuple]:
        """What is to be encoded: ("window", w), ("head" or "tail", spot, w) of chunks, and ("text", begin, end)."""
        out, w = [("window", k, lo, hi) for k, (lo, hi) in enumerate(self.windows)], 0
        for i, (b, e, d) in enumerate(self.spots):
            while w < len(self.windows) and self.windows[w][1] <= b:
                w += 1
            at = b
            for k in range(w, len(self.windows)):
                lo, hi = self.windows[k]
                if lo >= e:
                    break
                if d is None:
                    if at < lo:
                        out.append(("text", i, at, lo))
                elif lo <= b and hi < e:
                    out.append(("head", i, b, hi, k))
                elif lo > b:  # a chunk is cut by windows at its two ends only
                    out.append(("tail", i, lo, e, k))
                at = hi
            if d is None and at < e:
                out.append(("text", i, at, e))
        return out

    def agrees(self, ids: dict[tuple, bytes], size: int) -> bool:
        """Whether each window's ids begin and end as those of the chunks that it reaches into."""
        for ask, own in ids.items():
            if ask[0] in ("head", "tail"):
                window = ids[("window", ask[4], *self.windows[ask[4]])]
                if ask[0] == "tail" and (not own or window[:size] != own[:size]) or ask[0] == "head" and (not own or window[-size:] != own[-size:]):
                    return False
        return True

    def items(self, ids: dict[tuple, bytes], size: int) -> list[tuple[bytes | None, int, int, bytes]]:
        """(digest, ids to skip, ids to drop at the end, ids) in order."""
        out: list[tuple[int, bytes | None, int, int, bytes]] = []
        skip, drop = {}, {}
        for ask, own in ids.items():
            if ask[0] == "head":
                skip[ask[1]] = len(own) // size
            elif ask[0] == "tail":
                drop[ask[1]] = len(own) // size
            else:
                out.append((ask[2], None, 0, 0, own))
        covered = lambda b, e: any(lo <= b and hi >= e for lo, hi in self.windows)
        out += [(b, d, skip.get(i, 0), drop.get(i, 0), b"") for i, (b, e, d) in enumerate(self.spots) if d is not None and not covered(b, e)]
        out.sort(key=lambda x: x[0])
        joined: list[tuple[bytes | None, int, int, bytes]] = []
        for _, d, a, z, own in out:
            if d is None and joined and joined[-1][0] is None:
                joined[-1] = (None, 0, 0, joined[-1][3] + own)
            else:
                joined.append((d, a, z, own))
        return joined


def _plan(text: Text, flags: np.ndarray, words: int) -> Plan:
    spots: list[tuple[int, int, bytes | None]] = []
    for b, e, d, shared in zip(text.edges[:-1], text.edges[1:], text.digests, flags.tolist(), strict=True):
        if not shared and spots and spots[-1][2] is None:
            spots[-1] = (spots[-1][0], e, None)
        else:
            spots.append((b, e, d if shared else None))
    blanks = np.flatnonzero(BLANK[np.frombuffer(text.raw, np.uint8)]).tolist()
    return Plan(text, spots, blanks, words, [])


def recipes(texts: list[Text], flags: list[np.ndarray], c: Codec, s: Settings, own: bool = True) -> list[list[tuple[bytes | None, int, int, bytes]]]:
    """The items of each text; without ``own``, what stands between chunks is not encoded and has no ids."""
    plans = [_plan(t, f, s.words) for t, f in zip(texts, flags, strict=True)]
    left, out, size = list(range(len(plans))), [[] for _ in plans], c.type.itemsize
    while left:
        asks = []
        for i in left:
            plans[i].repaired()
            asks += [(i, ask) for ask in plans[i].asked() if own or ask[0] != "text"]
        got = c.encode([texts[i].raw[ask[2] : ask[3]].decode() for i, ask in asks])
        told: dict[int, dict[tuple, bytes]] = {i: {} for i in left}
        for (i, ask), ids in zip(asks, got, strict=True):
            told[i][ask] = ids
        for i in left if not own else []:
            told[i].update((ask, b"") for ask in plans[i].asked() if ask[0] == "text")
        again = []
        for i in left:
            whole = all((lo, hi) == (0, len(texts[i].raw)) for lo, hi in plans[i].windows)
            if whole or plans[i].agrees(told[i], size):
                out[i] = plans[i].items(told[i], size)
            else:
                plans[i].words *= 2
                again.append(i)
        left = again
    return out


Finish = Callable[[np.ndarray, Codec], tuple]


def _digests(ids: np.ndarray, c: Codec) -> tuple:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decoded(ids)).hexdigest()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _ids(ids: np.ndarray, _: Codec) -> tuple:
    return (ids.astype("<u4").tobytes(),)


def run(docs: DataFrame, path: str, finish: Finish, columns: str, settings: Settings = Settings()) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id and what ``finish`` makes of a document's ids, as ``columns`` tells."""
    s, spark = settings, docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]
    types = [pa.int64() if c.split()[1] == "long" else pa.binary() if c.split()[1] == "binary" else pa.string() for c in columns.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def told():
            keys, n = np.unique(_keys(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

        for p in _chunked(batches, s):
            held += [d for t in p.texts for d in t.digests]
            if len(held) > 1_000_000:
                yield told()
                held = []
        if held:
            yield told()

    seen = stored(docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "chunks")
    shared = spark.sparkContext.broadcast(members(seen, "key"))
    release(seen)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, last = codec(path, s.memo), None
        for batch in batches:
            for part in by_size(batch, most=s.part):
                digests, keep = part.column("digest").to_pylist(), []
                for k, d in enumerate(digests):
                    if d != last:
                        keep.append(k)
                    last = d
                own = c.encode(part.column("text").take(pa.array(keep, pa.int64())).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([digests[k] for k in keep], pa.binary()), pa.array([pack(x) for x in own], pa.binary())], ["digest", "chunk"])

    parts = {"doc_id": kind, "key": "binary", "seq": "int", "of": "int", "skip": "int", "drop": "int", "own": "binary"}

    def batch_of(rows: list[tuple], like: pa.RecordBatch, more: dict[str, pa.DataType]) -> pa.RecordBatch:
        kinds = {"doc_id": like.schema.field("doc_id").type, "key": pa.binary(), **{c: pa.int32() for c in ("seq", "of", "skip", "drop")}, **more}
        columns_of = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns_of, kinds.values(), strict=True)], list(kinds))

    def key_of(doc, raw: bytes) -> bytes:
        import xxhash

        return xxhash.xxh3_128_digest(repr(doc).encode() + b"|" + raw)

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The references of documents to shared chunks, with a chunk's text where the task meets it first."""
        c, given = codec(path, s.memo), set()
        for p in _chunked(batches, s):
            ids, rows = p.batch.column("doc_id").to_pylist(), []
            some = [(t, f) for t, f in zip(p.texts, _shared(p.texts, shared.value), strict=True) if f.any()]
            for (t, _), made in zip(some, recipes([t for t, _ in some], [f for _, f in some], c, s, False), strict=True):
                key, at = key_of(ids[t.row], t.raw), dict(zip(t.digests, zip(t.edges[:-1], t.edges[1:], strict=True), strict=True))
                for k, (d, a, z, _) in enumerate(made):
                    if d is not None:
                        rows.append((ids[t.row], key, k, len(made), a, z, d, None if d in given else t.raw[slice(*at[d])].decode()))
                        given.add(d)
            if len(given) > 1_000_000:
                given = set()
            yield batch_of(rows, p.batch, {"digest": pa.binary(), "text": pa.string()})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What stands between a document's references, and documents without any as they are finished."""
        c = codec(path, s.memo)
        for p in _chunked(batches, s):
            ids, rows = p.batch.column("doc_id").to_pylist(), []
            for t, made in zip(p.texts, recipes(p.texts, _shared(p.texts, shared.value), c, s), strict=True):
                key = key_of(ids[t.row], t.raw)
                if all(d is None for d, *_ in made):
                    rows.append((ids[t.row], key, -1, 1, 0, 0, None, *finish(c.ids(b"".join(own for *_, own in made)), c)))
                else:
                    rows += [(ids[t.row], key, k, len(made), 0, 0, pack(own), *[None] * len(names)) for k, (d, _, _, own) in enumerate(made) if d is None]
            yield batch_of(rows, p.batch, {"own": pa.binary(), **dict(zip(names, types, strict=True))})

    told = lambda more: ", ".join(f"{c} {k}" for c, k in parts.items() if c != "own") + more
    refs = stored(docs.mapInArrow(refer, told(", digest binary, text string")), "references", "zstd")
    first = refs.where("text IS NOT NULL").select("digest", "text").repartition("digest").sortWithinPartitions("digest")
    chunks = stored(first.mapInArrow(once, "digest binary, chunk binary"), "encoded", "zstd")
    del first
    lean = stored(refs.drop("text"), "references", "zstd")
    release(refs)  # the texts are not needed any more, neither stored nor shuffled
    refs = spread_join(lean, chunks, "digest").withColumnRenamed("chunk", "own").select(*parts)
    refs = refs.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in columns.split(", ")})
    given = docs.mapInArrow(write, told(f", own binary, {columns}")).unionByName(refs).repartition("key").sortWithinPartitions("key", "seq")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, s.memo)
        size = c.type.itemsize
        key, doc, of, times, held = None, None, 0, 0, []

        def whole():
            if len(held) != of:
                raise ValueError(f"a document has {len(held)} of its {of} parts")
            return [(doc, *finish(c.ids(b"".join(held)), c))] * times

        for batch in batches:
            out = []
            for d, k, seq, n, skip, drop, own, *done in zip(*(batch.column(x).to_pylist() for x in (*parts, *names)), strict=True):
                if seq < 0:
                    out.append((d, *done))
                    continue
                if k != key:
                    if key is not None:
                        out += whole()
                    key, doc, of, times, held = k, d, n, 0, []
                times += seq == 0  # rows alike have one key
                if seq == len(held):
                    own = unpack(own)
                    held.append(own[skip * size : len(own) - drop * size])
            yield made(out, batch)
        if key is not None:
            yield made(whole(), batch)

    def made(out: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [batch.schema.field("doc_id").type, *types]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)], ["doc_id", *names])

    return given.mapInArrow(assemble, f"doc_id {kind}, {columns}")


def digests(docs: DataFrame, path: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit integers), decoded_sha256 (of UTF-8)."""
    return run(docs, path, _digests, DIGESTS, settings)


def encoded(docs: DataFrame, path: str, settings: Settings = Settings()) -> DataFrame:
    """doc_id, ids: little-endian unsigned 32-bit integers."""
    return run(docs, path, _ids, "ids binary", settings)


def decoded(ids: Column, path: str) -> Column:
    """Ids as :func:`encoded` gives them -> text; null for null."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([None if r is None else c.decode(np.frombuffer(r, "<u4")) for r in rows], dtype=object)

    return text(ids)
