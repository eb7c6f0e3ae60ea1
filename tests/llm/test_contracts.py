"""Every contract query on the smallest tables against a plain version, on edge cases and
on empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from vellumgrid.llm import queries as q

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs():
    return {i: (t, lang) for i, t, lang in duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_edge_cases(spark, edge_dir, name):
    n = len(rows(q.QUERIES[name](spark, f"{edge_dir}/full")))
    if name not in ("op7_decontamination", "op9_pivot_search", "op11_collocations"):
        assert n == 10
    assert rows(q.QUERIES[name](spark, f"{edge_dir}/empty")) == []


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
@pytest.mark.parametrize("where", ["sf", "full"])
def test_sql(spark, edge_dir, name, where):
    at = SF if where == "sf" else f"{edge_dir}/full"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet{'' if where == 'sf' else '/*.parquet'}'")
    df = q.QUERIES[name](spark, at)
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted(con.sql(q.ORACLE_SQL[name]).project(", ".join(df.columns)).fetchall(), key=key)
    assert got == want


def test_language(spark, edge_dir, docs):
    got = rows(q.op1_language_id(spark, SF))
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]][1] for r in held]) > 0.97
    edge = {r["doc_id"]: r for r in rows(q.op1_language_id(spark, f"{edge_dir}/full"))}
    assert {edge[i]["lang_pred"] for i in (1, 2, 6, 8)} == {"und"} and all(0 <= r["score"] <= 1 for r in edge.values())


def test_suffix_tree(spark, docs):
    from vellumgrid.llm.suffix_tree import tokens

    got = {r["doc_id"]: r for r in rows(q.op3_suffix_tree(spark, SF))}
    counts = Counter(t for i, (text, _) in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text))
    n, v = counts.total(), len(counts)
    for i, (text, _) in docs.items():
        own = tokens(text)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), n)


def test_token_files_and_bpe(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    files = {r["doc_id"]: r for r in rows(q.op4_token_files(spark, SF))}
    coded = {r["doc_id"]: r for r in rows(q.op5_byte_bpe(spark, SF))}
    start = 0
    for i in sorted(docs):
        ids = library.encode(docs[i][0], add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert files[i] == {"doc_id": i, "start": start, "n_tokens": len(ids) + 1, "ids_crc32": zlib.crc32(raw + bytes(4))}
        assert coded[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(raw).hexdigest(), "decoded_sha256": hashlib.sha256(docs[i][0].encode()).hexdigest()}
        start += len(ids) + 1


def test_toxicity_and_quality_learn(spark):
    sf = "/root/testdata/sf0.01"
    labels = {i: (a, b) for i, a, b in duckdb.sql(f"select doc_id, quality, toxic from '{sf}/labels.parquet'").fetchall()}
    for query, at in ((q.op8_quality, 0), (q.op6_toxicity, 1)):
        held = [r for r in rows(query(spark, sf)) if r["held_out"] and r["doc_id"] in labels]
        assert len(held) > 50 and np.mean([r["predicted"] == labels[r["doc_id"]][at] for r in held]) > 0.93


def test_decontamination(spark, docs):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    norm = lambda t: " ".join(t.split())
    whole = {(i, k) for i, (t, _) in docs.items() for k, b in items if norm(b) in norm(t)}
    got = {(r["doc_id"], r["item_id"]) for r in rows(q.op7_decontamination(spark, SF))}
    assert whole and whole <= got
    assert len(got - whole) <= 1


def test_simhash(spark, docs):
    got = {r["doc_id"]: r for r in rows(q.op10_simhash(spark, SF))}
    prints = {}
    for i, (text, _) in docs.items():
        w = text.encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), seed=42) for k in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert got[i]["fingerprint"] == f"{prints[i]:016x}"
    ids, root = sorted(prints), {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert {i: got[i]["component_id"] for i in ids} == root
