"""Collocations against a plain count, chunk encoding against the library."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vellumgrid.llm import chunk_bpe, collocations
from vellumgrid.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain_phrases(docs, s):
    """Every rule of the contract, word by word."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, s.longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= s.least}
    inside = lambda p, q: p[0] == q[0] and any(p[1:] == q[i : i + len(p) - 1] for i in range(1, len(q) - len(p) + 2))
    rows = []
    for p, a in found.items():
        if any(len(o) > len(p) and 100 * b >= s.cover * a and inside(p, o) for o, b in found.items()):
            continue
        cuts = []
        for j in range(1, len(p) - 1):
            l, r = f[p[: j + 1]], f[(p[0], *p[j + 1 :])]
            cuts.append((s.scale * a * n[p[0]] // (l * r), j, l, r))
        score, cut, l, r = min(cuts)
        rows.append((p[0], -score, -a, " ".join(p[1:]).encode(), cut, l, r, n[p[0]]))
    rows.sort()
    place, out = Counter(), []
    for lang, score, a, phrase, cut, l, r, total in rows:
        place[lang] += 1
        if place[lang] <= s.top:
            out.append((lang, place[lang], phrase.decode(), cut, -a, l, r, total, -score))
    return out


@pytest.mark.parametrize("cover", [100, 60])
def test_phrases(spark, cover):
    rnd = random.Random(cover)
    parts = ["a", "A", "b", "c", "dé", "É", "a b c", "x y z w v u", " ", "\t", ".", ",", "\n", "\x0b", "!?", "\xa0", "日"]
    docs = [(" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de", None, "und", ""])) for _ in range(300)]
    docs += [(None, "en"), ("", None), ("a b c " * 2000, "en"), docs[0], docs[0]]
    s = collocations.Settings(least=6, cover=cover, top=40)
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "text string, lang string, id string, a int").repartition(3)
    got = sorted(tuple(r) for r in collocations.mine(df, s).select("lang", "rank", "phrase", "cut", "a", "l", "r", "n", "score").collect())
    want = sorted(plain_phrases(docs, s))
    assert {len(r[2].split(" ")) for r in want} >= {2, 3, 5}
    assert got == want


def test_counts_beyond_64_bits(spark):
    row = ("en", 1, 2, 3, 2, "p q", 9 * 10**14, 2 * 10**15, [10**15 + 1, 9 * 10**14], [10**15 + 7, 9 * 10**14])
    df = spark.createDataFrame([row], "lang string, id long, left long, right long, k int, phrase string, a long, n long, begins array<long>, ends array<long>")
    got = collocations.scored(df).first()
    assert (got["score"], got["cut"]) == (1000 * row[6] * row[7] // ((10**15 + 1) * (10**15 + 7)), 1)


def test_no_phrase(spark):
    df = spark.createDataFrame([("one two three", "en")], "text string, lang string")
    assert collocations.mine(df).collect() == [] and collocations.mine(df.limit(0)).collect() == []


ALPHABET = ["a", "B", "é", "é", " ", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x85", "\xa0", " ", "\x1c", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "12", ".", "!!", "İ", "Σ", "日", "하", "ᆫ", "̈́", "\U0001f642", "word", "the "]


def texts(n, most, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_parts_are_encoded_as_the_library_does(path, library):
    for memo in (50, 10_000):
        codec, rows = chunk_bpe.Codec(path, memo), texts(3000, 40, memo)
        rows.append("x" * 500)
        for part in (rows[:1500], rows[1500:], rows[:20]):
            assert [codec.ids(ids).tolist() for ids in codec.encode(part)] == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_joins_are_repaired(path, library):
    """Any chunks may be shared, and chunks end anywhere."""
    s, codec, rnd = chunk_bpe.Settings(zeros=3, least=8), chunk_bpe.Codec(path), random.Random(5)
    rows = texts(600, 300, 9) + ["x" * 700, ("ab" * 40 + " ") * 9, "\xa0".join(["word"] * 90)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["doc_id", "text"])
    referred = 0
    for p in chunk_bpe._chunked(iter([batch]), s):
        flags = [np.array([rnd.random() < 0.7 for _ in t.digests], bool) for t in p.texts]
        for t, made in zip(p.texts, chunk_bpe.recipes(p.texts, flags, codec, s), strict=True):
            assert b"".join(t.raw[b:e] for b, e in zip(t.edges[:-1], t.edges[1:], strict=True)) == t.raw
            chunks = {d: t.raw[b:e].decode() for d, b, e in zip(t.digests, t.edges[:-1], t.edges[1:], strict=True)}
            ids = []
            for digest, skip, drop, own in made:
                if digest is None:
                    ids += codec.ids(own).tolist()
                else:
                    chunk = library.encode(chunks[digest], add_special_tokens=False).ids
                    ids += chunk[skip : len(chunk) - drop]
                    referred += 1
            assert ids == library.encode(t.raw.decode(), add_special_tokens=False).ids
    assert referred > 1000


def test_a_disagreeing_repair_is_widened(path, library):
    """Words of no id bound the cut one, so that the ids around it can't be compared at first."""
    text = ("one " + "\xa0 " * 6 + "cutword " + "\xa0 " * 6 + "two").encode()
    codec, at = chunk_bpe.Codec(path), text.index(b"word")
    t = chunk_bpe.Text(text, [0, at, len(text)], [b"l" * 16, b"r" * 16], 0)
    plan = chunk_bpe._plan(t, np.array([True, True]), 1)
    plan.repaired()
    first = dict(zip(plan.asked(), codec.encode([text[a[2] : a[3]].decode() for a in plan.asked()]), strict=True))
    assert not plan.agrees({a: b"" if a[0] != "window" else ids for a, ids in first.items()}, 2)
    (made,) = chunk_bpe.recipes([t], [np.array([True, True])], codec, chunk_bpe.Settings())
    ids = []
    for digest, skip, drop, own in made:
        chunk = codec.ids(own).tolist() if digest is None else library.encode(text[:at].decode() if digest == b"l" * 16 else text[at:].decode(), add_special_tokens=False).ids
        ids += chunk if digest is None else chunk[skip : len(chunk) - drop]
    assert ids == library.encode(text.decode(), add_special_tokens=False).ids


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_and_edge_cases(spark, edge_dir, library):
    for at, files in ((SF, f"{SF}/documents.parquet"), (f"{edge_dir}/full", f"{edge_dir}/full/documents.parquet/*.parquet")):
        docs = duckdb.sql(f"select doc_id, text from '{files}'").fetchall()
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, q.op12_chunk_bpe(spark, at).collect()), key=key) == sorted(((i, *want(library, t)) for i, t in docs), key=key)


def test_shared_passages(spark, path, library):
    """Copies by the hundred, passages at any place, repeated rows and short chunks; and back to text."""
    rnd = random.Random(2)
    passage = " ".join(rnd.choice(["alpha", "Beta", "gamma's", "12", "déjà"]) + str(rnd.randint(0, 99)) for _ in range(400))
    rows = [(i, passage) for i in range(200)] + [(500 + i, t + passage[rnd.randint(0, 50) :] + t) for i, t in enumerate(texts(100, 60, 4))] + [(900, passage)] * 3 + [(None, passage[:900]), (901, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(5)
    s = replace(chunk_bpe.Settings(), zeros=6, least=32)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, chunk_bpe.digests(df, path, s).collect()), key=key) == sorted(((i, *want(library, t)) for i, t in rows), key=key)
    back = chunk_bpe.encoded(df, path, s).select("doc_id", chunk_bpe.decoded("ids", path).alias("t"))
    told = sorted(((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows), key=key)
    assert sorted(map(tuple, back.collect()), key=key) == told


def test_pairs_are_counted_in_bounded_memory():
    """Twelve million pairs, a million at a time, are never held at once, and all are counted."""
    def parts():
        for k in range(12):
            left = np.arange(1_000_000, dtype=np.uint64) * np.uint64(7) + np.uint64(k % 2)
            yield left, left + np.uint64(1)

    tracemalloc.start()
    total = sum(int(np.sum(b.column("a").to_numpy())) for b in collocations._count_pairs(parts()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 12_000_000 and most < 280 << 20


def test_decoding_is_the_librarys_without_a_call_to_it(path, library, monkeypatch):
    """Calls for each document made the check's CPU seconds too many."""
    codec = chunk_bpe.Codec(path)
    calls = []
    monkeypatch.setattr(chunk_bpe.Codec, "_decode", lambda self, ids: calls.append(1) or library.decode(list(ids), skip_special_tokens=False), raising=False)
    rng = np.random.default_rng(3)
    for ids in ([], [library.get_vocab_size() - 1], rng.integers(0, library.get_vocab_size(), 5000), range(library.get_vocab_size())):
        ids = np.array(ids, np.uint16)
        assert codec.decoded(ids).decode() == codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    assert not calls
    beyond = np.array([0, library.get_vocab_size(), 1], np.uint16)  # the library leaves out what it does not know
    assert codec.decode(beyond) == library.decode(beyond.tolist(), skip_special_tokens=False) and calls
