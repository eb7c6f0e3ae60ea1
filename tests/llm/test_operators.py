"""The methods themselves, on small inputs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumgrid.llm import bpe, common, decontaminate, langid, licenses, pfor, pivots, quality, simhash, suffix_tree, toxicity
from vellumgrid.llm.components import components
from vellumgrid.llm.license_rules import rules


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    raw = pfor.encode_segment(ids, np.array([len(ids)], np.uint32), 7, block=64)
    back, lengths, first = pfor.decode_segment(raw)
    assert back.tolist() == values and lengths.tolist() == [len(values)] and first == 7


def test_outliers_are_exceptions():
    block = np.array([5] * 99 + [1 << 31], np.uint32)
    raw = pfor.encode_block(block)
    assert raw[4] == 0 and len(raw) < 20 and pfor.decode_block(raw).tolist() == block.tolist()


@pytest.mark.parametrize("width", range(33))
def test_packing_at_every_width(width):
    rng = np.random.default_rng(width)
    for n in (1, 7, 8, 9, 250):
        values = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        raw = pfor.pack(values, width)
        bits = "".join(format(int(v), f"0{width}b")[::-1] for v in values) if width else ""
        assert raw == int(bits[::-1] or "0", 2).to_bytes((n * width + 7) // 8, "little")
        assert pfor.unpack(raw, n, width).tolist() == values.tolist()


def test_real_ids_are_packed_and_patched():
    """Most blocks of real ids are narrower than their largest id and hold exceptions."""
    import duckdb

    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    ids = np.frombuffer(b"".join(pfor.encoder(vocabulary("byte_bpe_50k.json"))(texts)), "<u4")
    blocks = [pfor.encode_block(ids[i : i + pfor.BLOCK]) for i in range(0, len(ids), pfor.BLOCK)]
    heads = [pfor.HEAD.unpack_from(b) for b in blocks]
    assert np.mean([h[3] > 0 for h in heads]) > 0.8 and np.mean([h[1] < 16 for h in heads]) > 0.8
    assert sum(map(len, blocks)) < 2 * len(ids)
    assert np.concatenate([pfor.decode_block(b) for b in blocks]).tolist() == ids.tolist()


def test_special_strings_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>\n y<|endoftext|><|endoftext|>  ", "none here"]
    for text, got in zip(texts, pfor.encoder(path)(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows_of_one_doc_id_have_a_fixed_order(spark):
    rows = [(1, f"text {i}") for i in range(50)] + [(None, f"no id {i}") for i in range(50)] + [(2, "x")]
    made = [sorted(map(str, pfor.checksums(pfor.write(spark.createDataFrame(order, "doc_id long, text string").repartition(n), pfor.fresh_path(spark, "t"), vocabulary("byte_bpe_50k.json"))).collect())) for order, n in ((rows, 3), (rows[::-1], 5))]
    assert made[0] == made[1] and len(made[0]) == 101


@given(st.text(alphabet=st.sampled_from("ab Z'\n\t é1.<|>漢\x1c"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_encoders_agree_with_the_libraries(text):
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.json")
    want = pfor.tokenizer(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(pfor.encoder(path)([text, None])[0], "<u4").tolist() == want
    enc = bpe.encoding(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = bpe.encode(text, enc, 3)
    assert ids.tolist() == enc.encode_ordinary(text) and bpe.decode(ids, enc) == text.encode()


@pytest.mark.parametrize("run", [" " * 60_000, "\n" * 50_001, " \n\t\u3000\x85" * 30_000])
def test_long_white_space_is_matched_apart(run):
    import public_tokenizers

    enc = bpe.encoding(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in (run, "abc " + run, run + "it's 44 \x1c漢", "7!" + run + " z"):
        assert bpe.encode(text, enc).tolist() == enc.encode_ordinary(text)
    longer = "a" + run * (2_000_000 // len(run)) + "b"  # the library's own matcher fails on it
    assert bpe.decode(bpe.encode(longer, enc), enc) == longer.encode()


class PlainTree:
    """The suffix tree of the docstring, with dictionaries."""

    def __init__(self, texts, s):
        self.s, self.runs = s, Counter()
        for t in texts:
            ws = tuple(suffix_tree.tokens(t))
            for k in range(1, s.depth + 2):
                self.runs.update(ws[i : i + k] for i in range(len(ws) - k + 1))
        self.n, self.v = sum(c for r, c in self.runs.items() if len(r) == 1), sum(len(r) == 1 for r in self.runs)
        self.kept = {}
        for k in range(2, s.depth + 2):
            found = {}
            for r, c in self.runs.items():
                total = self.runs[r[:-1]]
                grown = k == 2 or r[1:-1] in self.kept
                if len(r) == k and c >= s.joint and total >= s.context and grown and c * abs(math.log(c / total / self.p(r[1:-1], r[-1]))) > s.divergence:
                    found.setdefault(r[:-1], {})[r[-1]] = c - s.discount
            self.kept |= found

    def p(self, context, word):
        if not context:
            return (self.runs[(word,)] + 1) / (self.n + self.v + 1)
        below = self.p(context[1:], word)
        if context not in self.kept:
            return below
        whole = self.runs[context] + self.s.strength
        own = self.kept[context]
        return (own.get(word, 0) + (whole - sum(own.values())) * below) / whole

    def score(self, text):
        ws = tuple(suffix_tree.tokens(text))
        return sum(math.log10(self.p(ws[max(0, i - self.s.depth) : i], w)) for i, w in enumerate(ws))


@pytest.mark.parametrize("frequent", [0.02, 0.0])
def test_suffix_tree_is_the_plain_one(spark, frequent):
    """With few broadcast rows, tokens and values come by the join; the probabilities sum to one."""
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(500)]
    passages = [" ".join(rng.choices(words, k=12)) for _ in range(25)]
    texts = [" ".join(x for _ in range(rng.randint(0, 6)) for x in (rng.choice(passages), " ".join(rng.choices(words, k=rng.randint(0, 9))))) for _ in range(150)] + [None, "", "never seen"]
    s = suffix_tree.Settings(depth=3, context=4, joint=2, divergence=1.5, strength=2.0, frequent=frequent)
    docs = spark.createDataFrame([(i, i % 7 == 2 or i >= 150, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    plain = PlainTree([t for i, t in enumerate(texts) if not (i % 7 == 2 or i >= 150)], s)
    model = suffix_tree.fit(docs.where("not held_out"), s)
    got = {r.doc_id: r for r in suffix_tree.score(docs, model).collect()}
    assert len(got) == len(texts) and {len(c) for c in plain.kept} == {1, 2, 3}
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(plain.score(t)) and got[i].n_tokens == len(suffix_tree.tokens(t))
        assert got[i].n_known == sum((w,) in plain.runs for w in suffix_tree.tokens(t))
    seen = [r[0] for r in plain.runs if len(r) == 1]
    for context in list(plain.kept)[::40]:
        assert sum(plain.p(context, w) for w in seen) + plain.p(context, b"not a word") == pytest.approx(1)


@pytest.mark.parametrize("n_blocks", [5, 6, 7])
def test_trie_join_finds_all_pairs(n_blocks):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 7), replace=False))) for b in base for _ in range(6)]
    values = np.sort(np.array(flips, np.uint64))
    groups = np.zeros(len(values), np.int64)
    got = {(int(a), int(b)) for i, j in simhash.trie_pairs(values, groups, 4, leaf=4) for a, b in zip(i, j, strict=True)}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 4}
    assert got == want
    # every pair shares a band
    for i, j in want:
        same = int(values[i] ^ values[j])
        assert any(all((same >> s) & ((1 << w) - 1) == 0 for s, w in band) for band in simhash.bands(n_blocks, 4))


def test_hot_buckets_are_split(spark):
    rows = spark.createDataFrame([(i, i) for i in range(300)], "node long, fp long").cache()
    for bucket in (16, 4096):
        roots = components(simhash.links(rows, 4, bucket)).collect()
        assert {r["root"] for r in roots} == {0} and len(roots) == 300


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_components_of_hubs(spark):
    star = [(1000, i) for i in range(500)] + [(2000, i) for i in range(2001, 2400)] + [(3000, 3001), (3001, 2399), (5, -1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {i: -1 for i in (*range(-1, 500), 1000)} | {i: 2000 for i in (*range(2000, 2400), 3000, 3001)}


def test_spread_join_of_hot_keys(spark):
    left = spark.createDataFrame([(b"hot", i) for i in range(300)] + [(b"a", 1), (b"b", 2), (None, 3)] + [(None, i) for i in range(200)], "k binary, v int").cache()
    right = spark.createDataFrame([(b"hot", 10), (b"a", 20), (b"c", 30), (None, 40)], "k binary, w int")
    assert common.hot_keys(left, "k").count() == 2 and common.hot_keys(right, "k") is None
    for parts in (1, 1000):
        got = common.spread_join(left, right, "k", parts).groupBy("w").count().collect()
        assert {r["w"]: r["count"] for r in got} == {10: 300, 20: 1}


def test_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    near = base.copy()
    near[100] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(word() for _ in range(300))), (5, " ".join(base[:150])), (6, ""), (7, None), (None, " ".join(base))]
    gone = {r["doc_id"] for r in simhash.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone == {2, 3, 7}


def near_copies(rng, vocabulary):
    """Texts of 20 to 400 words with copies that are extended, shortened or changed, so
    that many similarities are just above or below 0.8."""
    texts = []
    for size in (20, 25, 40, 80, 150, 400):
        for share in (0.05, 0.1, 0.15, 0.18, 0.2, 0.22, 0.25, 0.3):
            base = rng.choices(vocabulary, k=size)
            more = rng.choices(vocabulary, k=round(size * share))
            edited = base.copy()
            edited[rng.randrange(size)] = "changed"
            texts += [base, base + more, more + base, base[len(more) :], edited]
    return [" ".join(t) for t in texts]


def jaccard(a, b):
    one, two = (set(simhash.shingles(simhash.words(t), 5)) for t in (a, b))
    return len(one & two) / len(one | two)


@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.sets(st.integers(0, 2**64 - 1), max_size=40), st.sets(st.integers(0, 2**64 - 1), max_size=400))
@settings(max_examples=60, deadline=None)
def test_parities_bound_the_difference(both, one, two):
    a, b = both | one, both | two
    maps = [simhash.parities(np.array(sorted(x), np.uint64)) for x in (a, b)]
    assert simhash.differing(*maps) <= len(a ^ b) and simhash.differing(maps[0], maps[0]) == 0


def test_copies_are_those_of_all_pairs(spark):
    """No link at 0.8 or more is lost: appended blocks, short texts and one-word edits."""
    rng = random.Random(7)
    texts = near_copies(rng, [f"w{i}" for i in range(3000)])
    root = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= 0.8]
    for _ in pairs:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for own in (simhash.CopySettings(), simhash.CopySettings(frequent=2, bucket=3, first=1)):
        gone = {r["doc_id"] for r in simhash.copies(docs, own).collect()}
        assert len(pairs) > 60 and gone == {i for i, r in enumerate(root) if i != r}


def test_reparameterised_question(spark):
    item = "A train leaves Paris at 9 and travels 120 km in 3 hours while Alice counts 9 birds"
    docs = [(1, f"Intro here. {item} and the rest."), (2, "So. A train leaves London at 7 and travels 250 miles in 5 hours while Bob counts 7 birds okay."), (3, "So. A train leaves London at 7 and travels 250 km in 5 hours while Bob counts 8 birds okay."), (4, "nothing to see in this text at all")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(10, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["reparameterised"]) for r in got} == {(1, False), (2, True)}


def test_a_passage_repeated_in_a_long_text(spark):
    """One row a document row, at the first place; items may begin before the text does."""
    item = "quick brown fox jumps over the lazy dog the quick brown fox"
    long = "fox jumps over the lazy dog. " + "The quick brown fox jumps over the lazy dog. " * 3000
    docs = spark.createDataFrame([(1, long), (1, long), (1, "something else entirely, without any of it"), (2, "over the lazy dog the quick brown fox and then more words that are no part of it")], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(10, item)], "item_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["coverage"]) for r in got.collect()) == [(1, 12, 1.0), (1, 12, 1.0)] + [(2, 8, pytest.approx(8 / 12))]


@pytest.mark.parametrize("size", [5, 8, 11, 15, 16, 17, 20, 33])
def test_leaks_at_every_offset(spark, size):
    """An item with any one word changed, and either half of it, at four places in a text."""
    item = [f"item{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(size)]
    half = -(-size // 2)
    parts = [item[:k] + ["changed"] + item[k + 1 :] for k in range(size)] + [item[:half], item[-half:]]
    docs = [" ".join(["before"] * off + part + ["after"] * 9) for part in parts for off in range(4)]
    got = decontaminate.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(10, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == set(range(len(docs)))


NOTICES = "Released under the MIT License. Licensed under the Apache License, Version 2.0; CC BY NC. SPDX-License-Identifier: GPL-2.0-or-later, GNU General Public License v3 or later. "


def test_licence_spans_as_by_all_pairs(spark):
    rng = random.Random(5)
    words = NOTICES.split()
    texts = [" ".join(rng.choices(words, k=80)) + " " + NOTICES * rng.randint(0, 3) for _ in range(40)] + ["", NOTICES, "mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spaced = "concat(' ', replace(translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ', '  '), ' ')"
    every = docs.withColumn("w", licenses.words_of(docs.text)).selectExpr("doc_id", f"{spaced} as t")
    every = {r.doc_id: r.found for r in every.select("doc_id", licenses._scan(every.t).alias("found")).collect()}
    seen = 0
    for row in licenses.scan(docs).collect():
        own = [(m.start, m.stop, m.ord) for m in every[row.doc_id] if m.ord]
        inside = lambda m, o: o[0] <= m[0] and o[1] >= m[1] and (o[1] - o[0] > m[1] - m[0] or o[2] < m[2])
        want = sorted(m for m in own if not any(inside(m, o) for o in own))
        assert sorted((m.start, m.stop, m.ord) for m in row.licences.kept) == want
        seen += len(own) - len(want)
    assert seen > 20


def test_a_licence_repeated_in_a_long_text(spark):
    n = 4_000
    row = licenses.scan(spark.createDataFrame([(1, NOTICES * n)], "doc_id long, text string")).first().licences
    each = len(licenses.scan(spark.createDataFrame([(1, NOTICES)], "doc_id long, text string")).first().licences.kept)
    assert len(row.base) == 3 * n and len(row.kept) == each * n
    size = row.n_words // n
    assert sorted(m.start for m in row.base if m.label == "mit") == [size * i + 1 for i in range(n)]


def test_every_keyword_gates_its_rule():
    import re

    assert len(rules()) > 200
    for _, _, keyword, regex in rules():
        fixed = re.sub(r"\(\?:[^()]*(\(\?:[^()]*\)\??)*[^()]*\)\?", "", regex)
        assert keyword in fixed


def language_model(*lists):
    """A model of de and en; each list, words first, has (gram, language, count)."""
    import pandas as pd

    kept = pd.DataFrame([(lang, size, g, n) for size, own in enumerate(lists) for g, lang, n in own], columns=["lang", "size", "gram", "n"])
    return langid._model(kept, ["de", "en"], langid.Settings(longest=len(lists) - 1))


def test_backoff():
    model = language_model([("the", "en", 9), ("der", "de", 9)], [], [("ch", "de", 5)])
    assert model.predict("the")[0] == "en" and model.predict("der the der")[0] == "de" and model.predict("ch")[0] in ("de", "en")
    assert model.predict("12 --") == ("und", 0.0) and model.predict(None) == ("und", 0.0)


@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from(["de", "en"]), st.integers(2, 50)), min_size=2, unique_by=lambda x: x[:2]), st.text("abcdefg ", min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_sparse_scores_are_the_smoothed_log_frequencies(words, text):
    model, counts = language_model(words), {x[:2]: x[2] for x in words}
    vocabulary = {w for w, _, _ in words}
    score = {}
    for lang in ("de", "en"):
        whole = sum(n for (_, x), n in counts.items() if x == lang) + 0.5 * len(vocabulary)
        score[lang] = sum(math.log((counts.get((w, lang), 0) + 0.5) / whole) for w in text.split() if w in vocabulary)
    got = model.predict(text)
    if text.strip():
        best = max(score.values())
        assert got[1] == pytest.approx(1 / sum(math.exp(x - best) for x in score.values())) and score[got[0]] == pytest.approx(best)


def test_pivot_search_is_exact_and_stops_early():
    rng = np.random.default_rng(0)
    c = (rng.normal(size=(8, 16))[rng.integers(0, 8, 800)] * 200 + rng.normal(size=(800, 16)) * 5).astype(np.int64)
    q, ids = c[:20], np.arange(800)
    far = pivots.distances(c.astype(float), pivots.choose(c.astype(float), 16))
    some = np.arange(0, 800, 7)
    floors = np.array([pivots._floor(q[a], a, c[some], ids[some], 5) for a in range(20)])
    work = []
    for floor in (np.full(20, -np.inf), floors):
        i, j, s, seen = pivots.block_top(q, ids[:20], far[:20], floor, c, ids, far, 5)
        for a in range(20):
            want = sorted(((-int(c[b] @ q[a]), b) for b in range(800) if b != a))[:5]
            assert [(-int(x), int(y)) for x, y in zip(s[i == a], j[i == a], strict=True)] == want
        work.append(seen)
    assert work[1] <= work[0] < 20 * 800


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 400)
    rows = [[f for f in range(4) if f < g or rng.random() < 0.05] for g in grade]
    weights, cuts = toxicity.regression(rows, grade, 4, toxicity.Settings())
    model = toxicity.Model({}, weights, cuts)
    p = model.distribution(np.array([sum(weights[f] for f in r) for r in rows]))
    assert (np.diff(cuts) > 0).all() and np.allclose(p.sum(1), 1) and np.corrcoef(p @ np.arange(4), grade)[0, 1] > 0.8


def test_attention_gradients_and_learning():
    good, bad = "Plain words in a row. " * 60, "BUY!! NOW!! " * 100
    texts = [good + bad if k % 2 else good for k in range(40)]
    x, bags = quality.encode(texts, 48)
    assert bags.sum() == len(x) and x.shape[1] == quality.N_FEATURES
    y = np.array([1.0 - k % 2 for k in range(40)])
    m = quality.train((x - x.mean(0)) / (x.std(0) + 0.02), bags, y, quality.Settings(steps=120))
    p = quality.forward((x - x.mean(0)) / (x.std(0) + 0.02), bags, m)[0]
    assert ((p > 0.5) == (y > 0.5)).all()
    one, n = quality.encode(["", None, "a"], 48)
    assert n.tolist() == [1, 1, 1] and np.isfinite(one).all()


def test_language_of_a_long_run_of_letters():
    model = language_model([], [("a", "de", 7), ("b", "en", 7)])
    assert model.predict("a" * 64 + "b" * 500)[0] == "en" and model.predict("a" * 500 + "b" * 64)[0] == "de"
    assert not model.cache


def test_toxicity_features_and_scores_by_hand(spark):
    """Every feature that passes the test is kept, and a score is the sum of its weights."""
    rng = random.Random(3)
    clean, bad = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)], [f"vile{chr(97 + i)}" for i in range(12)]
    texts = [(i, " ".join(rng.choices(clean, k=20) + (rng.choices(bad, k=rng.randint(1, 6)) if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(400)]
    docs, labels = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, y int")
    model, s = toxicity.fit(docs, labels), toxicity.Settings()
    n, toxic, want = len(texts), sum(t[2] for t in texts), set()
    held = [(toxicity.features(t, s.prefix), y) for _, t, y in texts]
    for f in set().union(*(h for h, _ in held)):
        a, b = sum(f in h for h, y in held if y), sum(f in h for h, y in held if not y)
        if 5 <= a + b < n and n * (a * (n - toxic - b) - b * (toxic - a)) ** 2 / ((a + b) * (n - a - b) * toxic * (n - toxic)) > s.chi2:
            want.add(f)
    assert set(model.vocabulary) == want and len(want) >= 12
    got = {r.doc_id: r.p for r in docs.union(spark.createDataFrame([(-1, None), (-2, "")], docs.schema)).select("doc_id", toxicity.scorer(spark, model)("text").alias("p")).collect()}
    for i, text, y in [*texts, (-1, None, 0), (-2, "", 0)]:
        x = sum(model.weights[model.vocabulary[f]] for f in toxicity.features(text, s.prefix) if f in model.vocabulary)
        below = [*(1 / (1 + np.exp(x - c)) for c in model.cuts), 1.0]
        assert got[i].severity == pytest.approx(sum(1 - b for b in below)) and got[i].score == pytest.approx(1 - below[0])
        assert (got[i].score > 0.5) == bool(y)


def test_ordinal_fit_is_a_best_one():
    """No small step of a weight or a threshold makes the penalised likelihood better."""
    rng = np.random.default_rng(4)
    rows = [sorted(set(rng.integers(0, 4, 3).tolist())) for _ in range(300)]
    grade = np.clip(np.array([sum(r) for r in rows]) // 2 + rng.integers(-1, 2, 300), 0, 2)
    s = toxicity.Settings(steps=4000, learning_rate=0.02)
    weights, cuts = toxicity.regression(rows, grade, 4, s)

    def loss(w, c):
        edges, total = np.array([-np.inf, *c, np.inf]), 0.0
        for r, g in zip(rows, grade, strict=True):
            high, low = (1 / (1 + np.exp(-(edges[g + k] - w[r].sum()))) for k in (1, 0))
            total -= np.log(high - low)
        return total / len(rows) + s.ridge * (w**2).sum() / 2

    best = loss(weights, cuts)
    for k in range(4):
        for step in (-0.05, 0.05):
            assert loss(weights + step * (np.arange(4) == k), cuts) > best - 1e-6
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(weights, cuts + step * (np.arange(2) == k)) > best - 1e-6


def test_candidates_hardly_exceed_the_links(spark, monkeypatch):
    """Passages that many texts hold give no row for each pair of them, and each link is followed once, not again in every round."""
    rng = random.Random(11)
    passages = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=12)) for _ in range(40)]
    texts = [" ".join(rng.sample(passages, 10)) for _ in range(150)]
    texts += [f"{t} more" for t in texts[:40]]
    pairs, followed = [], []
    candidates, follow = simhash.candidates, simhash.components

    def counted(*args):
        pairs.append(candidates(*args).cache())
        return pairs[-1]

    def followed_by(links):
        followed.append(links.distinct().count())
        return follow(links)

    monkeypatch.setattr(simhash, "candidates", counted)
    monkeypatch.setattr(simhash, "components", followed_by)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r["doc_id"] for r in simhash.copies(docs, simhash.CopySettings(sample=0)).collect()}
    assert gone == set(range(150, 190))
    assert sum(p.count() for p in pairs) < 200 and sum(followed) < 60


@given(st.lists(st.tuples(st.sets(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 1500)), min_size=2, max_size=6), st.integers(0, 99))
@settings(max_examples=40, deadline=None)
def test_sketches_bound_the_difference(sets, seed):
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    sets = [np.unique(np.concatenate([np.array(sorted(x), np.uint64), common[:n]])) for x, n in sets]
    import pyarrow as pa

    sketches = simhash.Sketches(pa.array([simhash.Sketches.folded(simhash.parities(x)) for x in sets], pa.binary()))
    x, y = (i.ravel() for i in np.indices((len(sets), len(sets))))
    for a, b, d in zip(x, y, sketches.differing(x, y), strict=True):
        assert d <= len(np.setxor1d(sets[a], sets[b])) and (a != b or d == 0)
