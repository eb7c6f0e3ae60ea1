"""SimHash near-duplicates by a binary trie self-join.

Fingerprints within ``k`` differing bits agree on at least one block if their 64 bits
are cut into k + 1 blocks, and on all of some n - k blocks if cut into n.  Every choice
of n - k blocks is a *band*; fingerprints that share a band's bits meet in one bucket,
which is a subtree of the trie over the bits in that band's order.  Inside, pairs of trie nodes are
traversed together: differing bits accumulate, and a pair of nodes is dropped once they
exceed the budget.  n grows with the number of fingerprints, which keeps buckets small;
the links found are the same for every n.

A bucket returns a spanning forest of its links (one link a fingerprint at most) and
never all pairs.  Buckets of more than ``bucket`` fingerprints are cut into chunks that
meet pairwise in tasks of their own.  Exact copies are one fingerprint throughout.

Defined cases: null text counts as empty; a text without words has fingerprint 0 and
is linked like any other; rows with a null doc_id are grouped too but never name a
component (null only if no member has an id); repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean, members, pieces, release, sampled, small, spread_join, stored
from .components import components

SEED = 42


@dataclass(frozen=True)
class Settings:
    shingle: int = 4  # words
    k: int = 4  # differing bits
    bucket: int = 4096
    blocks: int | None = None  # None: by the number of fingerprints


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(ws: list[bytes], n: int) -> list[bytes]:
    """All windows of n words, space-joined; fewer words: the whole sequence; none: none."""
    if not ws:
        return []
    joined = b" ".join(ws)
    if len(ws) <= n:
        return [joined]
    stops = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate([[0], stops[:-1]])
    return [joined[a:b] for a, b in zip(starts[: len(ws) - n + 1].tolist(), (stops[n - 1 :] - 1).tolist(), strict=True)]


def fingerprint(items: list[bytes], seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the items' XXH64."""
    if not items:
        return 0
    digest = xxhash.xxh64_digest
    return _majority(np.frombuffer(b"".join([digest(x, seed) for x in items]), np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of 64-bit hashes."""
    return _majority(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)) if len(hashes) else 0


def _majority(raw: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(raw), 4096):
        counts += np.unpackbits(raw[at : at + 4096], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(raw)).tobytes(), "big")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, fp (the 64 bits as a long)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                fps = [fingerprint(shingles(words(t), shingle)) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _signed(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def blocks_for(n: int, k: int) -> int:
    """The number of blocks with the least work for n fingerprints spread evenly; two more
    than the budget at least, so that the rows in buckets are in proportion to n over
    any range of sizes that one cluster sees."""
    from math import comb

    def work(b: int) -> float:
        return comb(b, k) * (n + n * n / 2 ** (64 * (b - k) // b) / 20)

    return min(range(k + 2, k + 6), key=work)


def bands(n_blocks: int, k: int) -> list[list[tuple[int, int]]]:
    """For each band its (shift, width) blocks."""
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    parts = [(64 - b, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(parts, n_blocks - k)]


def band_keys(fp: Column, n_blocks: int, k: int) -> Column:
    """array of struct(band, key)."""
    out = []
    for i, band in enumerate(bands(n_blocks, k)):
        key = F.lit(0).cast("long")
        for shift, width in band:
            bits = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        out.append(F.struct(F.lit(i).alias("band"), key.alias("key")))
    return F.array(*out)


# -- the trie self-join ------------------------------------------------------


def _ones(values: np.ndarray, bit: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)])


def trie_pairs(values: np.ndarray, groups: np.ndarray, k: int, leaf: int = 256, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within ``k`` bits inside each group; ``values`` (uint64) are
    sorted within each group.  A node is a range of the sorted values; the frontier of
    node pairs of all groups moves down one bit at a time."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [len(groups)]]) if len(groups) else starts
    stack = [(0, np.stack([starts, ends, starts, ends], 1), np.zeros(len(starts), np.int64))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, nodes, diff = stack.pop()
        a, b = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
        same = nodes[:, 0] == nodes[:, 2]
        live = ~(same & (a < 2))
        ready = live & ((a * b <= leaf) | (bit == 64))
        if ready.any():
            yield from _leaves(values, nodes[ready], k, most)
        go = live & ~ready
        if not go.any():
            continue
        nodes, diff, same = nodes[go], diff[go], same[go]
        if len(nodes) > 200_000:  # depth first beyond this width
            half = len(nodes) // 2
            stack += [(bit, nodes[:half], diff[:half]), (bit, nodes[half:], diff[half:])]
            continue
        c = ones.get(bit)
        if c is None:
            c = ones[bit] = _ones(values, bit)
        left = nodes[:, 1] - (c[nodes[:, 1]] - c[nodes[:, 0]])
        right = nodes[:, 3] - (c[nodes[:, 3]] - c[nodes[:, 2]])
        zero_a, one_a = (nodes[:, 0], left), (left, nodes[:, 1])
        zero_b, one_b = (nodes[:, 2], right), (right, nodes[:, 3])
        children, bits = [], []
        for x, y, extra, of in ((zero_a, zero_b, 0, None), (one_a, one_b, 0, None), (zero_a, one_b, 1, None), (one_a, zero_b, 1, ~same)):
            made, d = np.stack([*x, *y], 1), diff + extra
            ok = (made[:, 1] > made[:, 0]) & (made[:, 3] > made[:, 2]) & (d <= k)
            if of is not None:  # (A0, A1) of a node with itself counts once
                ok &= of
            children.append(made[ok])
            bits.append(d[ok])
        stack.append((bit + 1, np.concatenate(children), np.concatenate(bits)))


def _leaves(values: np.ndarray, nodes: np.ndarray, k: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    a, b = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
    sizes = np.cumsum(a * b)
    at = 0
    while at < len(nodes):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        part, n = nodes[at:to], (a * b)[at:to]
        which = np.repeat(np.arange(len(part)), n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i = part[which, 0] + inner // b[at:to][which]
        j = part[which, 2] + inner % b[at:to][which]
        ok = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= k)
        yield i[ok], j[ok]
        at = to


def join_forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest index of each component) after the links i-j."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return labels
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further


def bucket_links(values: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """For each value the first value of its component inside its group."""
    labels = np.arange(len(values))
    for i, j in trie_pairs(values, groups, k):
        labels = join_forest(labels, i, j)
    return labels


def chunked(rows: DataFrame, sizes: DataFrame, keys: list[str], member: str, bucket: int) -> DataFrame:
    """``rows`` with i, j: groups (by ``keys``) of more than ``bucket`` rows are cut into
    chunks, of which any two, i and j, meet; ``sizes`` has the rows n of each group."""
    hot = small(cut(sizes.where(F.col("n") > bucket).select(*keys, F.ceil(F.col("n") / bucket).cast("int").alias("chunks"))))
    rows = rows.join(hot, keys, "left")
    chunk = F.pmod(F.xxhash64(member), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(chunk, j).alias("i"), F.greatest(chunk, j).alias("j")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    rows = rows.withColumn("c", F.explode(F.when(F.col("chunks").isNull(), one).otherwise(pairs)))
    return rows.withColumns({"i": F.col("c.i"), "j": F.col("c.j")}).drop("c", "chunks")


def by_group(rows: DataFrame, keys: list[str], solve: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``solve(rows of whole groups, number of each row's group)`` over groups by ``keys``."""

    def solved(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for c in keys:
            own = table.column(c).to_numpy()
            new[1:] |= own[1:] != own[:-1]
        return solve(table, np.cumsum(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= 100_000:  # whole groups only
                whole = pa.concat_tables(held)
                cols = [whole.column(c).to_numpy() for c in keys]
                last = np.logical_or.reduce([c != c[-1] for c in cols])
                cut_at = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if cut_at:
                    yield solved(whole.slice(0, cut_at))
                held, size = [whole.slice(cut_at)], whole.num_rows - cut_at
        if held:
            yield solved(pa.concat_tables(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), schema)


def links(nodes: DataFrame, k: int, bucket: int = 4096, blocks: int | None = None) -> DataFrame:
    """``nodes(node, fp)`` -> a, b: links that span the components of the relation
    "within k bits".  ``nodes`` must be materialised; it is read twice."""
    n_blocks = blocks or blocks_for(nodes.count(), k)
    rows = nodes.select("node", "fp", F.explode(band_keys(F.col("fp"), n_blocks, k)).alias("x")).select("x.band", "x.key", "node", "fp")
    sizes = nodes.select(F.explode(band_keys(F.col("fp"), n_blocks, k)).alias("x")).groupBy("x.band", "x.key").agg(F.count("*").alias("n"))
    rows = chunked(rows, sizes, ["band", "key"], "node", bucket).select("band", "key", "i", "j", "fp", "node")

    def solve(table: pa.Table, groups: np.ndarray) -> pa.RecordBatch:
        fp, node = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy()
        order = np.lexsort((node, fp, groups))
        fp, node, groups = fp[order], node[order], groups[order]
        first = bucket_links(fp, groups, k)
        least = np.full(len(node), np.iinfo(np.int64).max, np.int64)
        np.minimum.at(least, first, node)  # the same root in most buckets of a group
        root = least[first]
        linked = np.flatnonzero(root != node)
        return pa.RecordBatch.from_arrays([pa.array(root[linked]), pa.array(node[linked])], ["a", "b"])

    return by_group(rows, ["band", "key", "i", "j"], solve, "a long, b long").where(F.col("a") != F.col("b"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, fingerprint (hex), component_id (the smallest
    doc_id reachable)."""
    s = settings
    fps = cut(fingerprints(docs, s.shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")))
    roots = components(links(nodes.select("node", "fp"), s.k, s.bucket, s.blocks))
    named = cut(nodes.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(named, ids, "root").select("fp", "component_id")
    return spread_join(fps, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- removal of near copies by shingle similarity -----------------------------


@dataclass(frozen=True)
class CopySettings:
    shingle: int = 5  # words of the shingles that similarity is measured on
    similarity: float = 0.8
    sample: int = 20_000  # documents, in expectation, that frequent shingles are told from
    frequent: int = 4  # documents of the sample that hold a frequent shingle
    most: int = 200_000  # frequent shingles that are broadcast
    bucket: int = 2048
    k: int = 4  # bits of the fingerprints that copies are first looked for with
    first: int = 16  # partners that a document takes from one group in the first round


def shingle_set(text: str | None, n: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, SEED) for x in shingles(words(text), n)], np.uint64))


def parities(hashes: np.ndarray) -> bytes:
    """Of each of some power of two of bins (two an element or more) whether it holds an odd number of hashes."""
    bins = 1 << max(8, (2 * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """At least so many elements are in one of two sets with these parities only."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


class Sketches:
    """Parities of many sets, of half of the bins (256 at least): their pairs are held against each other in bulk."""

    def __init__(self, odd: pa.Array):
        ends = np.frombuffer(odd.buffers()[1], np.int32)[odd.offset : odd.offset + len(odd) + 1]
        data, begin, self.widths = np.frombuffer(odd.buffers()[2] or b"", np.uint8), ends[:-1].astype(np.int64), np.diff(ends)
        self.at, self.words = {}, {}
        for width in np.unique(self.widths).tolist():
            rows = np.flatnonzero(self.widths >= width)
            words = np.empty((len(rows), width), np.uint8)
            for own in np.unique(self.widths[rows]).tolist():
                of = np.flatnonzero(self.widths[rows] == own)
                for part in np.array_split(of, len(of) * own // (1 << 21) + 1):
                    words[part] = np.bitwise_xor.reduce(data[begin[rows[part]][:, None] + np.arange(own)].reshape(len(part), -1, width), axis=1)
            self.at[width] = np.full(len(self.widths), -1, np.int64)
            self.at[width][rows] = np.arange(len(rows))
            self.words[width] = words.view(np.uint64)

    @staticmethod
    def folded(odd: bytes) -> bytes:
        x = np.frombuffer(odd, np.uint8)
        return np.bitwise_xor.reduce(x.reshape(-1, max(32, len(x) // 2)), axis=0).tobytes()

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """At least so many elements are in one of the sets x[i] and y[i] only."""
        out, width = np.zeros(len(x), np.int64), np.minimum(self.widths[x], self.widths[y])
        for w in np.unique(width).tolist():
            at, words, of = self.at[w], self.words[w], np.flatnonzero(width == w)
            for part in np.array_split(of, len(of) * w // (1 << 23) + 1):
                out[part] = np.bitwise_count(words[at[x[part]]] ^ words[at[y[part]]]).sum(1, dtype=np.int64)
        return out


def prefix_length(size: int, similarity: float) -> int:
    """Sets of that similarity share an element among so many first ones of each, in any
    order that all sets have in common."""
    return size - int(np.ceil(similarity * size - 1e-9)) + 1 if size else 0


def frequent_shingles(docs: DataFrame, s: CopySettings) -> np.ndarray:
    """Hashes of shingles that many documents of a sample hold, the rarest first."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = [shingle_set(t, s.shingle) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    chosen = docs.where(sampled(F.col("doc_id"), "copies", min(1.0, s.sample / max(1, docs.count()))))
    counts = chosen.select("text").mapInArrow(lean(made), "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= s.frequent)
    return counts.orderBy(F.desc("n"), "h").limit(s.most).toPandas()["h"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def candidates(rows: DataFrame, sizes: DataFrame, most: int, s: CopySettings) -> DataFrame:
    """``rows(h, key, size, pos, root, odd)`` and ``sizes(h, n)`` -> a, b: pairs whose similarity can be reached, by
    prefix filtering: the first shingle that two sets share is in both prefixes, and what
    follows it in the shorter remainder bounds what they share; and so do the folded parities ``odd``, which
    leave hardly more pairs than there are links.  Documents of one group (``root``)
    need no pair, and a document takes ``most`` partners of another group, those with the
    smallest keys; where a shingle h has more, a row (-1, h) says so."""
    rows = chunked(rows, sizes, ["h"], "key", s.bucket).select("h", "i", "j", "key", "size", "pos", "root", "odd")

    def solve(table: pa.Table, groups: np.ndarray) -> pa.RecordBatch:
        key, size, pos, root = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "size", "pos", "root"))
        h = table.column("h").to_numpy()
        order = np.lexsort((size, groups))
        key, size, pos, root, groups, h = (x[order] for x in (key, size, pos, root, groups, h))
        sketches = Sketches(table.column("odd").combine_chunks().take(pa.array(order)))
        # rows of a group are met by those after them of up to size / similarity
        at = groups * (1 << 32) + size
        stop = np.searchsorted(at, groups * (1 << 32) + np.floor(size / s.similarity + 1e-6).astype(np.int64), side="right")
        n = stop - np.arange(len(key)) - 1
        done, found, over, from_ = np.cumsum(n), [], [], 0
        while from_ < len(key):
            to = max(from_ + 1, int(np.searchsorted(done, (done[from_ - 1] if from_ else 0) + (1 << 20), side="right")))
            own = n[from_:to]
            x = np.repeat(np.arange(from_, to), own)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own)
            shared = np.minimum(size[x] - pos[x], size[y] - pos[y])
            ok = (shared >= s.similarity / (1 + s.similarity) * (size[x] + size[y]) - 1e-6) & (root[x] != root[y])
            x, y = x[ok], y[ok]
            total, apart = size[x] + size[y], sketches.differing(x, y)
            ok = total - apart >= s.similarity * (total + apart) - 1e-6
            x, y = x[ok], y[ok]
            for _ in range(2):  # either side's partners
                by = np.lexsort((key[y], root[y], x))
                x, y = x[by], y[by]
                first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (root[y[1:]] != root[y[:-1]])])) if len(x) else np.zeros(0, np.int64)
                rank = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
                over.append(h[x[rank >= most]])
                x, y = y[rank < most], x[rank < most]
            found.append(np.stack([np.minimum(key[x], key[y]), np.maximum(key[x], key[y])], 1))
            from_ = to
        left = np.unique(np.concatenate(over)) if over else np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate([*found, np.zeros((0, 2), np.int64)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[:, 0], np.full(len(left), -1)])), pa.array(np.concatenate([pairs[:, 1], left]))], ["a", "b"])

    return by_group(rows, ["h", "i", "j"], solve, "a long, b long").distinct()


def shared_rows(named: DataFrame, shared) -> DataFrame:
    """``named(key, size, root, prefix, odd)`` -> h, key, size, pos, root, odd (folded): a row for each shingle of a prefix
    that the broadcast bitmap ``shared`` has, as others are in one prefix only."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                prefix = piece.column("prefix")
                n = prefix.value_lengths().to_numpy(zero_copy_only=False)
                h = prefix.flatten().to_numpy().view(np.uint64)
                at = np.flatnonzero(shared.value.has(h))
                of = np.repeat(np.arange(len(n)), n)[at]
                odd = pa.array([Sketches.folded(x) for x in piece.column("odd").to_pylist()], pa.binary())
                taken = {c: piece.column(c).take(pa.array(of)) for c in ("key", "size", "root")}
                pos = (at - (np.cumsum(n) - n)[of]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), taken["key"], taken["size"], pa.array(pos), taken["root"], odd.take(pa.array(of))], ["h", "key", "size", "pos", "root", "odd"])

    return named.select("key", "size", "root", "prefix", "odd").mapInArrow(lean(made), "h long, key long, size int, pos int, root long, odd binary")


def merged(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """The groups ``roots(node, root)`` after the links ``pairs(a, b)``, of which only those between groups, as
    links of their roots, are followed."""
    root = lambda c: small(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")))
    named = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    between = named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
    between = cut(between)
    if not between.limit(1).count():
        return roots
    to = small(components(between).select(F.col("root").alias("to"), F.col("node").alias("root")))
    new = to.select(F.col("root").alias("node"), "root").join(roots.select("node"), "node", "left_anti")
    return cut(roots.unionByName(new).join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def grouped(nodes: DataFrame, items: Callable[[DataFrame], DataFrame], s: CopySettings) -> DataFrame:
    """``nodes(key, size, prefix, fp, odd)``, materialised, and ``items(keys)`` -> key, items -> node, root: the
    groups that all pairs of the stated similarity make, of nodes in any pair.

    The trie join over the fingerprints comes first, and its links are proven on the shingles; so a large
    group is mostly one when the candidates of the prefixes are taken, of which the rounds
    take more and more of a document in one group, until none is left out.  Most candidates
    fall to a bound that is certain, by parities of two to four bits a shingle."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("sa").to_numpy().astype(np.int64) + batch.column("sb").to_numpy()
            apart = np.array([differing(a, b) for a, b in zip(batch.column("oa").to_pylist(), batch.column("ob").to_pylist(), strict=True)], np.int64)
            near = total - apart >= s.similarity * (total + apart) - 1e-6
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], ["a", "b"])

    def proven(pairs: DataFrame) -> DataFrame:
        odd = lambda c: nodes.select(F.col("key").alias(c), F.col("size").alias(f"s{c}"), F.col("odd").alias(f"o{c}"))
        pairs = cut(pairs.join(odd("b"), "b").join(odd("a"), "a").mapInArrow(lean(possible), "a long, b long").distinct())
        sets = stored(items(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "items")
        side = lambda c: sets.select(F.col("key").alias(c), F.col("items").alias(f"i{c}"))
        both = F.size(F.array_intersect("ia", "ib"))
        near = both >= s.similarity * (F.size("ia") + F.size("ib") - both) - 1e-9
        made = cut(pairs.join(side("b"), "b").join(side("a"), "a").where(near).select("a", "b"))
        release(sets)
        return made

    roots = components(proven(cut(links(nodes.select(F.col("key").alias("node"), "fp").where(F.size("prefix") > 0), s.k, s.bucket).distinct())))
    sizes = cut(nodes.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    most, left = s.first, None
    while True:
        named = nodes.join(small(roots.withColumnRenamed("node", "key")), "key", "left").withColumn("root", F.coalesce("root", "key"))
        rows = shared_rows(named, nodes.sparkSession.sparkContext.broadcast(members(sizes if left is None else left, "h")))
        made = cut(candidates(rows if left is None else rows.join(small(left), "h", "left_semi"), sizes, most, s))
        roots = merged(roots, proven(made.where(F.col("a") >= 0)))
        left = cut(made.where(F.col("a") < 0).select(F.col("b").alias("h")).distinct())
        if not left.limit(1).count():
            return roots
        most *= 8


def copies(docs: DataFrame, settings: CopySettings = CopySettings()) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id of every document that repeats another: of each
    group of exact or near copies (linked by a Jaccard similarity of the shingles of
    ``similarity`` or more) all but the smallest doc_id.  Candidates are complete and every
    link is proven on the shingles; fingerprints and the order of shingles, frequent ones last, only save work."""
    s = settings
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    often = frequent_shingles(docs, s)
    by_hash = np.argsort(often)
    shared = docs.sparkSession.sparkContext.broadcast((often[by_hash], by_hash + 1))
    same = lambda text: xxhash.xxh3_128_digest(b" ".join(words(text)))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = shared.value
        for batch in batches:
            for piece in pieces(batch):
                texts, sizes, prefixes, fps, odd = [], [], [], [], []
                for text in piece.column("text").to_pylist():
                    own = shingle_set(text, s.shingle)
                    if len(hashes):
                        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                        order = np.argsort(np.where(hashes[at] == own, ranks[at], 0), kind="stable")
                    else:
                        order = np.arange(len(own))
                    texts.append(same(text))
                    sizes.append(len(own))
                    fps.append(majority(own))
                    odd.append(parities(own))
                    prefixes.append(own[order[: prefix_length(len(own), s.similarity)]].view(np.int64))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(texts, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), _signed(fps), pa.array(odd, pa.binary())], ["doc_id", "same", "size", "prefix", "fp", "odd"])

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column("text").to_pylist()
                items = [shingle_set(t, s.shingle).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(map(same, texts), pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["same", "items"])

    rows = cut(docs.mapInArrow(lean(described), "doc_id long, same binary, size int, prefix array<bigint>, fp long, odd binary"))
    # exact copies: one row each from here on
    nodes = rows.groupBy("same").agg(F.min("doc_id").alias("key"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("fp").alias("fp"), F.first("odd").alias("odd"))
    nodes = cut(nodes)

    def items(keys: DataFrame) -> DataFrame:
        """Shingles are made again, of the documents in pairs only; one doc_id may have many texts."""
        texts = docs.join(small(cut(keys.withColumnRenamed("key", "doc_id"))), "doc_id", "left_semi").select("text")
        made = texts.mapInArrow(lean(collected), "same binary, items array<bigint>").groupBy("same").agg(F.first("items").alias("items"))
        return nodes.join(keys, "key", "left_semi").select("key", "same").join(made, "same").select("key", "items")

    roots = grouped(nodes.select("key", "size", "prefix", "fp", "odd"), items, s)
    near = roots.where(F.col("node") != F.col("root")).select(F.col("node").alias("doc_id"))
    exact = spread_join(rows.select("doc_id", "same"), nodes.select("same", F.col("key").alias("node")), "same").where(F.col("doc_id") != F.col("node")).select("doc_id")
    return exact.unionByName(near).distinct()
