"""Decontamination against a plain version that compares every item with every text at every
shift, and the cases that its rule promises."""

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from vellumgrid.llm import decontaminate
from vellumgrid.llm.decontaminate import Settings

SF = "/root/testdata/sf0.001"
S = Settings()


def templated(spark, rows):
    """id -> (template words, lower-case words)."""
    df = spark.createDataFrame(rows, "at long, text string")
    return {r[0]: (r[1], [w.lower() for w in r[2]]) for r in df.select("at", decontaminate.template(df.text), decontaminate.originals(df.text)).collect()}


def wanted(n):
    """(length, need) of an item of n words, by the rule as the docstring states it."""
    if n < S.least:
        return n, 1
    run, altered = min(S.run, max(1, n // 2)), int(n * S.altered)
    for two in (2, 1):
        for w in range(min(S.window, run), 0, -1):
            left = n - w + 1 - altered * w
            if left >= two:
                return w, min(left, run - w + 1)


def plain(docs, items):
    """{(doc, item): (words that count, values altered)}"""
    out = {}
    for d, (words, raw) in docs.items():
        where = defaultdict(list)
        for p, w in enumerate(words):
            where[w].append(p)
        for k, (mine, own) in items.items():
            shifts = defaultdict(set)
            for i, w in enumerate(mine):
                for p in where[w]:
                    shifts[p - i].add(i)
            length, need = wanted(len(mine))
            counted, altered = set(), False
            for shift, agreed in shifts.items():
                if sum(all(i + j in agreed for j in range(length)) for i in agreed) < need:
                    continue
                same = {i for i in agreed if own[i] == raw[i + shift]}
                pairs = {(own[i], raw[i + shift]) for i in agreed if mine[i] in "\x02\x03\x04"}
                clash = len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs)
                if len(mine) < S.least:
                    agreed = same if len(same) == len(mine) else set()
                elif clash:
                    agreed = same if len(same) >= S.verbatim * len(agreed) else set()
                counted |= agreed
                altered |= any(own[i] != raw[i + shift] and mine[i] in "\x02\x03\x04" for i in agreed)
            if counted and len(counted) >= S.coverage * len(mine):
                out[d, k] = (len(counted), altered)
    return out


def found(spark, docs, items, settings=S):
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), settings).collect()
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    return {(r.doc_id, r.item_id): (r.n_words, r.reparameterised) for r in got}


def edited(rng, text):
    words = text.split()
    n, kind = len(words), rng.randrange(5)
    if kind == 0:  # scattered, as many as promised
        for i in rng.sample(range(n), int(n * S.altered)):
            words[i] = f"zz{i}q"
    elif kind == 1:  # at even distances
        step = rng.choice([3, 4, 5, 6, 8])
        words = [f"zz{i}q" if i % step == step - 1 else w for i, w in enumerate(words)]
    elif kind == 2:  # a part
        at = rng.randrange(n // 2 + 1)
        words = words[at : at + rng.randint(n // 3, n)]
    elif kind == 3:  # a number goes wrong
        words = [str(int(w) + 1) if w.isdigit() and rng.random() < 0.4 else w for w in words]
    else:  # a word comes in
        words.insert(rng.randrange(n), "inserted")
    return " ".join(words)


def test_as_by_all_shifts(spark):
    """All items and texts of the table, numbered and short items, and edited items inside texts."""
    rng = random.Random(7)
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet' order by 1").fetchall()
    texts = duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null order by doc_id").fetchall()
    words = " ".join(t for _, t in items).split()
    for size in range(1, 20):
        items.append((1000 + size, " ".join(rng.choices(words, k=size))))
        items.append((2000 + size, " ".join(rng.choice([w, w, str(rng.randint(2, 5)), "kg"]) for w in rng.choices(words, k=size))))
    docs = [t for (t,) in texts]
    for _, text in items * 5:
        before, after = rng.choice(texts)[0][:200], rng.choice(texts)[0][-200:]
        docs.append(f"{before} {edited(rng, text)} {after}")
    docs = list(enumerate(docs))
    want = plain(templated(spark, docs), templated(spark, items))
    assert len(want) > 200
    assert found(spark, docs, items) == want
    assert found(spark, docs[-150:], items, Settings(broadcast_windows=0, spread=5)) == {k: v for k, v in want.items() if k[0] >= len(docs) - 150}


@pytest.mark.parametrize("size", [*range(5, 26), 30, 41, 60])
def test_seeds_keep_what_they_promise(spark, size):
    """No choice of altered words, within the share, spoils more windows than are asked for."""
    length, need = spark.range(1).select(decontaminate.seeds(F.lit(size), S)).first()[0]
    assert (length, need) == wanted(size) and length >= 1 and need >= 1
    rng, altered = random.Random(size), int(size * S.altered)
    evenly = [{length - 1 + k * length for k in range(altered)}] + [set(rng.sample(range(size), altered)) for _ in range(300)]
    for gone in evenly:
        assert sum(not gone & set(range(i, i + length)) for i in range(size - length + 1)) >= need
    assert min(S.run, size // 2) - length + 1 >= need


def test_scattered_edits_one_wrong_number_and_short_items(spark):
    item = "we put 3 red apples into a basket and then 3 green pears on top before counting what was left in there"
    words = item.split()
    docs = [
        " ".join("changed" if i % 6 == 5 else w for i, w in enumerate(words)),
        item.replace("3 green", "5 green"),
        item.replace("3", "4"),
        item.replace("3 red", "4 red").replace("3 green", "5 green"),
        "so then, the capital of Peru is Lima they say",
        "so then, the capital of Chile is not Lima they say",
        "a bag weighs 5 kg here",
        "a bag weighs 6 kg here",
    ]
    items = [(1, item), (2, "The capital of Peru"), (3, "weighs 5 kg")]
    got = found(spark, list(enumerate(docs)), items)
    assert {k: v[1] for k, v in got.items()} == {(0, 1): False, (1, 1): False, (2, 1): True, (3, 1): False, (4, 2): False, (6, 3): False}
    assert got[1, 1][0] == len(words) - 1 and got[3, 1][0] == len(words) - 2


def test_empty_tables_and_clashing_columns(spark):
    text = "one item of some words that stands in a text as it is"
    docs = spark.createDataFrame([(1, text, 5, "x"), (1, text, 5, "x"), (None, text, 5, "x"), (2, None, 5, "x"), (3, "", 5, "x")], "doc_id long, text string, hash int, item string")
    items = spark.createDataFrame([(1, text, 7), (2, text, 7), (3, None, 7), (4, "", 7), (None, text, 7), (5, "?!", 7)], "item_id long, text string, shift int")
    got = decontaminate.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got) == [(1, 1, 1.0), (1, 1, 1.0), (1, 2, 1.0), (1, 2, 1.0)]
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert decontaminate.leaks(a, b).collect() == []
