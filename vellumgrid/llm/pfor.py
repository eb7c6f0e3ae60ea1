"""Token ids in patched frame-of-reference blocks.

File format (all integers little-endian).  A *segment* is one binary value:

    magic "PFR2" | u32 ids | u32 documents | u32 blocks | u32 block size
    u64 start of each block in the payload (the block index)
    u64 first id number of the segment within its shard
    payload: blocks of ids, then blocks of document lengths

A block: u32 minimum | u8 width | u16 values | u16 exceptions | u8 patch bytes | packed residuals |
u16 positions | patches.  Residuals (value - minimum) are packed at the width that
holds ``percentile`` of them, value i in the bits from i * width.  Of larger ones the low bits are
packed with the others, and the high bits are the patches, of 1, 2 or 4 bytes each.

Segments are rows of a Parquet table (shard, segment, doc_ids, payload), so that any
store that Spark writes to can hold them and a lost task is simply written again.
Shards are ranges of ascending doc_id.

Encoding is that of the library with its file's settings: the string of a special token in a
text is that token.  Rows that share a doc_id are in the order of their texts' hashes.

Defined cases: null text counts as empty (just the end id); rows with a null doc_id
come first; repeated rows are kept; an empty table gives no segment; other columns are not looked at.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, shared_dir

MAGIC = b"PFR2"
HEAD = struct.Struct("<IBHHB")
BLOCK = 2048
SEGMENT = 1 << 20  # ids of a segment, about
PERCENTILE = 94.0
BREAK = re.compile(r"(?<=\S)(?= )")
FINE = re.compile(r"(?<=[A-Za-z])(?=[\x00-\x40\x5B-\x60\x7B-\x7F])|(?<=\S)(?=\s)")


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value."""
    size = (len(values) * width + 7) // 8
    if not width:
        return b""
    if width > 16:
        bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    # eight values fill ``width`` bytes: four make the low word, four the high one
    rows = np.zeros(-(-len(values) // 8) * 8, np.uint64)
    rows[: len(values)] = values & np.uint32((1 << width) - 1)
    rows = rows.reshape(-1, 2, 4)
    half = rows[..., 0] | rows[..., 1] << np.uint64(width) | rows[..., 2] << np.uint64(2 * width) | rows[..., 3] << np.uint64(3 * width)
    if width == 16:
        return half.astype("<u8").tobytes()[:size]
    low = half[:, 0] | half[:, 1] << np.uint64(4 * width)
    high = half[:, 1] >> np.uint64(64 - 4 * width)
    return np.stack([low, high], 1).astype("<u8").view(np.uint8)[:, :width].tobytes()[:size]


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    if width > 16:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n * width).reshape(n, width)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :width] = bits
        return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    rows = -(-n // 8)
    wide = np.zeros((rows, 16), np.uint8)
    flat = np.zeros(rows * width, np.uint8)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    wide[:, :width] = flat.reshape(rows, width)
    words, mask = wide.view("<u8").astype(np.uint64), np.uint64((1 << width) - 1)
    if width < 16:
        words[:, 1] = words[:, 0] >> np.uint64(4 * width) | words[:, 1] << np.uint64(64 - 4 * width)
    out = np.empty((rows, 2, 4), np.uint32)
    for k in range(4):
        out[..., k] = words >> np.uint64(k * width) & mask
    return out.reshape(-1)[:n]


def encode_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """``values``: at most 65,535 unsigned 32-bit integers."""
    if not len(values):
        return HEAD.pack(0, 0, 0, 0, 1)
    low = int(values.min())
    rest = (values - np.uint32(low)).astype(np.uint32)
    k = min(len(rest) - 1, int(len(rest) * percentile / 100))
    width = int(np.partition(rest, k)[k]).bit_length()
    patches = rest >> np.uint32(width) if width < 32 else np.zeros(0, np.uint32)
    over = np.flatnonzero(patches)
    patches = patches[over]
    size = next(b for b in (1, 2, 4) if not len(over) or int(patches.max()) < 1 << 8 * b)
    return HEAD.pack(low, width, len(values), len(over), size) + pack(rest, width) + over.astype("<u2").tobytes() + patches.astype(f"<u{size}").tobytes()


def decode_block(raw: memoryview | bytes) -> np.ndarray:
    low, width, n, over, size = HEAD.unpack_from(raw)
    at = HEAD.size + (n * width + 7) // 8
    values = unpack(raw[HEAD.size : at], n, width)
    if over:
        where = np.frombuffer(raw, "<u2", over, at)
        values[where] |= np.frombuffer(raw, f"<u{size}", over, at + 2 * over).astype(np.uint32) << np.uint32(width)
    return values + np.uint32(low)


def encode_segment(ids: np.ndarray, lengths: np.ndarray, first: int, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    blocks = [encode_block(x[i : i + block], percentile) for x in (ids, lengths) for i in range(0, len(x), block)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8")
    return MAGIC + struct.pack("<IIII", len(ids), len(lengths), len(blocks), block) + starts.tobytes() + struct.pack("<Q", first) + b"".join(blocks)


def decode_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """ids, lengths of the documents, and the number of the first id in the shard."""
    if raw[:4] != MAGIC:
        raise ValueError("not a segment")
    n, docs, blocks, _ = struct.unpack_from("<IIII", raw, 4)
    starts = np.frombuffer(raw, "<u8", blocks, 20)
    (first,) = struct.unpack_from("<Q", raw, 20 + 8 * blocks)
    body = memoryview(raw)[28 + 8 * blocks :]
    values = [decode_block(body[int(a) :]) for a in starts]
    flat = np.concatenate(values) if values else np.zeros(0, np.uint32)
    return flat[:n], flat[n : n + docs], first


def read_block(raw: bytes, k: int) -> np.ndarray:
    """One block by the index alone."""
    blocks = struct.unpack_from("<I", raw, 12)[0]
    start = np.frombuffer(raw, "<u8", blocks, 20)[k]
    return decode_block(memoryview(raw)[28 + 8 * blocks + int(start) :])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _plain_bytes(library) -> bool:
    """Whether the file's settings are those that :class:`Encoder` may cut texts for."""
    told = json.loads(library.to_str())
    pre, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    return (
        told.get("normalizer") is None
        and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and all(t.get("special") and not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in told.get("added_tokens", []))
    )


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in
    order, for the code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: 256 + k for k, b in enumerate(other)}


class Encoder:
    """Encodes with the tokenizers library, each distinct piece of text once.

    A match of the byte-level pre-splitting pattern spans neither the place between a
    non-space and a white space nor that between an ASCII letter and an ASCII character
    that is no letter, so a text's ids are those of its pieces.  Texts are cut at spaces;
    pieces not met before are cut further, as a rare piece is mostly a known word with
    other punctuation.  A piece of Latin letters is one match and goes straight to the
    library's model.  Of the pieces met, the last ``most`` to twice as many are kept.  A text that holds
the string of a special token, and every text if the file has other settings, goes to the library whole."""

    def __init__(self, path: str, most: int = 500_000):
        self.library, self.most = tokenizer(path), most
        self.model, self.letters = self.library.model, _byte_letters()
        self.cuts = _plain_bytes(self.library)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # pieces are kept here instead
        #: word -> ids of the word after a space; the same without one
        self.new, self.old, self.bare = {}, {}, {}

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        if len(self.bare) > self.most:
            self.bare = {}
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        whole = np.full(len(texts), not self.cuts)
        for name in self.special:
            whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._cut(texts)
        ids = iter(_raw(e.ids) for e in self.library.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False))
        cut = iter(self._cut(texts.filter(pa.array(~whole))))
        return [next(ids) if w else next(cut) for w in whole.tolist()]

    def _cut(self, texts: pa.Array) -> list[bytes]:
        # runs of white space are cut before the first of them only
        odd = pc.match_substring_regex(texts, WIDE)
        where = odd.to_numpy(zero_copy_only=False)
        if not where.any():
            return self._coded(pc.split_pattern(texts, " "))
        plain = iter(self._coded(pc.split_pattern(texts.filter(pc.invert(odd)), " ")))
        other = iter(self._coded(pa.array([self._words(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))))
        return [next(other) if w else next(plain) for w in where.tolist()]

    def _coded(self, lists: pa.ListArray) -> list[bytes]:
        if not len(lists):
            return []
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words, base = lists.flatten(), offsets[0]
        offsets = offsets - base
        lead = np.zeros(len(words), bool)
        lead[offsets[:-1]] = True
        firsts = words.filter(pa.array(lead)).to_pylist()
        coded = words.filter(pa.array(~lead)).dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        new = self.new
        self._learn({w for w in distinct if w not in new}, {f for f in firsts if f and f not in self.bare})
        made = list(map(new.__getitem__, distinct))
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        flat = np.frombuffer(b"".join(made), "<u4")
        n = sizes[codes]
        ends = np.cumsum(n)
        # every word's ids, in the order of the words
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], ends])[offsets - np.arange(len(offsets))] * 4
        raw, bare = ids.tobytes(), self.bare
        return [(bare[f] if f else b"") + raw[a:b] for f, a, b in zip(firsts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _learn(self, missing: set[str], firsts: set[str]) -> None:
        new, old, bare = self.new, self.old, self.bare
        cut, atoms = {}, set()
        for word in missing:
            if word in old:
                new[word] = old[word]
            elif LATIN.fullmatch(word):
                new[word] = self._one(" " + word)
            else:
                cut[word] = parts = FINE.split(" " + word)
                atoms.update(parts)
        heads = {f: FINE.split(f) for f in firsts}
        for parts in heads.values():
            atoms.update(parts)
        rest = []
        for a in atoms:
            word = a[1:]
            if a[0] != " ":
                if a not in bare:
                    rest.append(a)
            elif word not in new:
                if word in old:
                    new[word] = old[word]
                elif LATIN.fullmatch(word):
                    new[word] = self._one(a)
                else:
                    rest.append(a)
        made = {}
        for a, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False) if rest else (), strict=True):
            made[a] = _raw(e.ids)
            if a[0] != " ":
                bare[a] = made[a]
        ids = lambda a: made[a] if a in made else new[a[1:]] if a[0] == " " else bare[a]
        for word, parts in cut.items():
            new[word] = b"".join(map(ids, parts))
        for first, parts in heads.items():
            bare[first] = b"".join(map(ids, parts))

    def _one(self, piece: str) -> bytes:
        """Ids of a space with letters, which is one match of the pattern."""
        letters = SPACE + piece[1:] if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return _raw([t.id for t in self.model.tokenize(letters)])

    @staticmethod
    def _words(text: str) -> list[str]:
        """What stands before the first cut, then what follows the space of each cut."""
        first, *rest = BREAK.split(text)
        if first[:1] == " ":
            return ["", first[1:], *(p[1:] for p in rest)]
        return [first, *(p[1:] for p in rest)]


def _raw(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _NATIVE else np.array(ids, "<u4").tobytes()


#: White space before a space.
WIDE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
SPACE = chr(_byte_letters()[32])
LATIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path)


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write segments to ``path``; returns the table."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, number, first = encoder(vocabulary), 0, 0
        stop = np.array([end], "<u4").tobytes()
        held, keys, n = [], [], 0

        def out():
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = np.fromiter((len(h) // 4 for h in held), np.uint32, len(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([encode_segment(ids, lengths, first)], pa.binary())],
                ["shard", "segment", "ids", "doc_ids", "payload"],
            )

        for batch in batches:
            for piece in by_size(batch):
                for key, ids in zip(piece.column("doc_id").to_pylist(), encode(piece.column("text")), strict=True):
                    held.append(ids + stop)
                    keys.append(key)
                    n += len(held[-1]) // 4
                    if n >= segment:
                        yield out()
                        number, first, held, keys, n = number + 1, first + n, [], [], 0
        if held:
            yield out()

    # the hash parts and orders the rows of one doc_id, or of none
    keys = ["doc_id", "at"]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("at"), "text").repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    ranged.select("doc_id", "text").mapInArrow(shard, "shard int, segment int, ids long, doc_ids array<bigint>, payload binary").write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.parquet(path)


def read(segments: DataFrame) -> DataFrame:
    """Per document of a written table: doc_id, start, n_tokens, ids (little-endian
    unsigned 32-bit integers), in no particular order."""
    return _described(segments, lambda ids: ids, "ids binary", pa.binary())


def checksums(segments: DataFrame) -> DataFrame:
    """As :func:`read`, with the unsigned crc32 of the ids instead of the ids."""
    return _described(segments, zlib.crc32, "ids_crc32 long", pa.int64())


def _described(segments: DataFrame, of, column: str, kind: pa.DataType) -> DataFrame:
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lengths, first = decode_segment(batch.column("payload")[k].as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                values = [of(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[k].values, pa.array([batch.column("shard")[k].as_py()] * len(ends), pa.int32()), pa.array(first + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(values, kind)],
                    ["doc_id", "shard", "start", "n_tokens", column.split()[0]],
                )

    # one row a shard: their number is that of the writing tasks
    totals = segments.groupBy("shard").agg(F.sum("ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    rows = segments.select("shard", "doc_ids", "payload").mapInArrow(unpacked, f"doc_id long, shard int, start long, n_tokens long, {column}")
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", column.split()[0])


def fresh_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
