"""Queries against their SQL, BM25 against SQLite's FTS5, and the sinks."""

import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from vellumgrid.operators import lexical, ranking, stored
from vellumgrid.plans import catalog
from vellumgrid.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = plain(df.select(columns).collect())
    if name in catalog.ORACLE:
        asked = duck.sql(catalog.ORACLE[name])
        assert sorted(asked.columns) == columns
        assert rows == plain(asked.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_bm25_is_that_of_fts5(spark):
    docs = [(1, "the cat sat on the mat"), (2, "a dog and a cat"), (3, "dogs chase cats daily"), (4, ""), (5, "net income of the dog"), (6, "income net")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(text, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, text) values (?, ?)", docs)
    want = dict(con.execute("""select rowid, -bm25(t) from t where t match '"cat" OR "net income" OR "daily"'""").fetchall())
    index = lexical.build(spark.createDataFrame(docs, "id long, text string"), stem=True)
    asked = spark.createDataFrame([(0, [["cat"], ["net", "incom"], ["daili"]])], "qid int, phrases array<array<string>>")
    got = {r["id"]: r["score"] for r in lexical.scores(index, asked).collect()}
    assert got == pytest.approx(want)
    again = lexical.stored(index.postings(), index.lengths)
    assert {r["id"]: r["score"] for r in lexical.scores(again, asked).collect()} == pytest.approx(want)


def test_fusion_ties_keep_the_dense_list_first(spark):
    make = lambda rows: spark.createDataFrame(rows, "qid int, id int, rank int")
    out = ranking.fuse(make([(0, 7, 1), (0, 8, 2)]), make([(0, 9, 1), (0, 8, 2)]), 3).orderBy("rank").collect()
    assert [r["id"] for r in out] == [8, 7, 9]
    assert out[1]["score"] == pytest.approx(1 / 61)
    assert spark.range(1).select(ranking.quota(5, F.lit(2)), ranking.quota(8, F.lit(2)), ranking.quota(8, F.lit(11))).first()[:] == (3, 4, 3)


def test_partition_replacement_keeps_years_as_strings(spark, tmp_path):
    schema, path = "id string, ticker string, year string", str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, schema)
    tables.replace_partitions(make([("a", "F", "2024"), ("b", "F", "2025")]), path)
    tables.replace_partitions(make([("c", "F", "2025")]), path)
    assert sorted(tables.read_partitions(spark, path, schema).collect()) == [("a", "F", "2024"), ("c", "F", "2025")]


def test_filings_and_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"years": ["2024"], "tickers": {"Autos": ["F", "GM"]}, "names": {"F": "Ford"}, "aliases": {"F": ["Ford", "F"]}}')
    found = tables.config(spark, str(tmp_path / "c.json"))
    assert found["companies"].count() == 2 and found["years"].first()["year"] == "2024"
    assert [r["case_sensitive"] for r in found["aliases"].orderBy("alias_pos").collect()] == [False, True]
    rows = spark.createDataFrame([(1, ["10-K", "10-Q"], ["a", "b"], ["x", "y"], ["2024-01-01", "2024-02-01"])], "cik int, form array<string>, accessionNumber array<string>, primaryDocument array<string>, reportDate array<string>")
    assert tables.filings(rows).select("pos", "form", "reportDate").collect() == [(0, "10-K", "2024-01-01"), (1, "10-Q", "2024-02-01")]


def test_stream_lands_pages(spark, tmp_path):
    from vellumgrid.streaming.ingest import start

    schema = "id string, ticker string, year string"
    spark.createDataFrame([("a", "F", "2024")], schema).write.parquet(str(tmp_path / "in"))
    start(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck"), lambda b: b).awaitTermination(60)
    assert tables.read_partitions(spark, str(tmp_path / "out"), schema).count() == 1


def test_plans(spark):
    """Filters reach the scan; top-k is cut before the shuffle; vectors meet in matrix products over Arrow batches, not in
    a nested loop; no row-wise Python in the paths."""
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan(catalog.metadata_filter(spark, SF)) and "EqualTo(source,src3)" in plan(catalog.metadata_filter(spark, SF))
    dense = plan(catalog.vector_topk(spark, SF))
    assert "WindowGroupLimit" in dense and "MapInArrow" in dense and "NestedLoop" not in dense and "Cartesian" not in dense
    for df in (dense, plan(catalog.rrf_fusion(spark, SF))):
        assert "BatchEvalPython" not in df and "MapInPandas" not in df


def test_fetch_reports_and_failures(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no such host")
        return b"page"

    out = tables.fetched(spark.createDataFrame([("http://a",), ("http://bad",)], "url string"), "me@example.com", 0, get)
    assert [(r["url"], r["status"], r["error"]) for r in out.orderBy("url").collect()] == [("http://a", "done", None), ("http://bad", "failed", "no such host")]
    with pytest.raises(ValueError, match="agent"):
        tables.fetched(out, "")
    small = spark.createDataFrame([(1, "a|b")], "n int, t string")
    assert tables.markdown(small, "T").splitlines() == ["# T", "", "| n | t |", "|-|-|", r"| 1 | a\|b |"]
    assert '"t": "a|b"' in tables.pretty(small)


def test_ensure_rebuilds_on_drift(spark):
    made = lambda cols: lambda: spark.createDataFrame([(1, "x")], cols)
    assert tables.ensure(spark, "kept", "a int", made("a int, b string")).columns == ["a"]
    assert tables.ensure(spark, "kept", "a int, b string", made("a int, b string")).columns == ["a", "b"]
    spark.sql("drop table kept")


def test_retrieve(spark):
    from vellumgrid.functions.models import embedded
    from vellumgrid.plans.retrieve import retrieve

    texts = {"F": "Ford builds trucks and reports net income", "GM": "General Motors sells electric vehicles and net income", "X": "weather was fine"}
    rows = [(f"{t}-{y}-{i}", t, y, "Item 1", f"{text} part {i}") for t, text in texts.items() for y in ("2024", "2025") for i in range(4)]
    rows += [("empty", "X", "2025", "Item 1", ""), ("null", "X", "2025", "Item 1", None), ("marks", "F", "2025", "Item 1", "!?")]
    chunks = spark.createDataFrame(rows, "id string, ticker string, year string, section string, text string")
    store = stored.rows(chunks, embedded(F.col("text")))
    asked = spark.createDataFrame([(1, "Compare the profit of Ford and GM"), (2, "Ford trucks in 2023"), (3, "fine weather"), (4, "???"), (5, None)], "qid int, question string")
    aliases = {"F": ["Ford"], "GM": ["General Motors", "GM"]}
    for mode in ("hybrid", "dense"):
        got = retrieve(asked, store, aliases, ["F", "GM"], mode=mode).collect()
        of = lambda q: [r for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == q]  # noqa: B023, E731
        assert sorted(r["ticker"] for r in of(1)) == ["F"] * 3 + ["GM"] * 3 and {r["year"] for r in of(1)} == {"2025"}
        assert {r["ticker"] for r in of(2)} == {"F"} and len(of(2)) == 5
        assert of(3)[0]["ticker"] == "X" and [r["rank"] for r in of(3)] == [1, 2, 3, 4, 5]
        assert not of(4) and not of(5) and not {"empty", "null", "marks"} & {r["id"] for r in got}
        assert all(0 <= r["distance"] <= 1.5 for r in got)


def test_vectors_that_can_not_be_ranked(spark):
    v = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [2.0, 2.0]), (7, [1.0, 0.0, 0.0]), (8, []), (9, [float("inf"), 0.0]), (10, [3.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "a" if r[0] < 6 else None) for r in v], "id int, v array<double>, g string").repartition(3)
    queries = spark.createDataFrame([(0, [5.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [0.0, 1.0, 0.0])], "qid int, q array<double>")
    got = sorted((r["qid"], r["rank"], r["id"], round(r["distance"], 6)) for r in ranking.dense_top_k(queries, vectors).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 10, 0.0), (0, 3, 6, 0.292893), (3, 1, 7, 1.0)]
    got = sorted((r["qid"], r["g"] or "", r["id"]) for r in ranking.dense_top_k(queries, vectors, 1, ("g",)).collect())
    assert got == [(0, "", 10), (0, "a", 1), (3, "", 7)]
    assert ranking.dense_top_k(queries.where("qid IN (1, 2)"), vectors).collect() == [] and ranking.dense_top_k(queries, vectors.limit(0)).collect() == []


def test_stored_scores_are_those_of_the_index(spark):
    """Phrases, filters, many asks and ties, against the index of occurrences."""
    words = ["net", "income", "of", "the", "dog", "cat", "net income", "x1"]
    told = lambda i: None if i % 50 == 0 else " ".join(words[(i * 7 + j * j * 3 + i // 11) % len(words)] for j in range(1, 2 + i % 13))
    docs = spark.createDataFrame([(i, f"f{i % 3}", "2025", "s", told(i)) for i in range(700)], "id long, ticker string, year string, section string, text string").repartition(4)
    phrases = [[["net", "income"], ["dog"]], [["cat"], ["of", "the", "dog"]], [["income", "net"]], [["nothing"]], [], [["the"], ["x1"], ["the"]]]
    asked = spark.createDataFrame([(q, phrases[q % 6]) for q in range(600)], "qid int, phrases array<array<string>>")
    want = lexical.search(lexical.build(docs.select("id", "text")), asked.where("qid < 6"), n=7)
    got = stored.lists(stored.rows(docs), asked.withColumnRenamed("qid", "ask"), keyword=7).select("ask", "id", "rank", F.round("value", 9))
    want = sorted((r["qid"], r["id"], r["rank"], round(r["score"], 9)) for r in want.collect())
    got = sorted(map(tuple, got.collect()))
    assert want and [r for r in got if r[0] < 6] == want and {r[0] % 6 for r in got} == {0, 1, 2, 5} and len(got) == 100 * len(want)
    asks = asked.where("qid = 0").select(F.col("qid").alias("ask"), "phrases", F.lit("f1").alias("ticker"))
    assert {r["id"] % 3 for r in stored.lists(stored.rows(docs), asks).collect()} == {1}
    assert stored.lists(stored.rows(docs), asks.limit(0)).collect() == [] and stored.lists(stored.rows(docs.limit(0)), asks).collect() == []


def test_many_asks_are_answered_by_one_scan(spark):
    """Equal scores over many batches leave the smallest ids, with filters and vectors too."""
    docs = spark.range(5000).select((4999 - F.col("id")).alias("id"), F.lit("s").alias("section"), F.lit("2025").alias("year"), F.concat(F.lit("f"), F.col("id") % 3).alias("ticker"), F.when(F.col("id") % 7 == 0, "cat dog").otherwise("cat").alias("text"))
    store = stored.rows(docs.repartition(3), F.array(F.lit(1.0), F.lit(0.0))).cache()
    asks = spark.range(600).select(F.col("id").alias("ask"), F.array(F.array(F.lit("dog"))).alias("phrases"), F.array(F.lit(2.0), F.lit(1.0)).cast("array<float>").alias("q"), F.when(F.col("id") == 599, "f1").alias("ticker"))
    found = stored.lists(store, asks, dense=3, keyword=4)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault((r["ask"], r["dense"]), []).append(r["id"])
    dogs = [i for i in range(5000) if (4999 - i) % 7 == 0]
    other = lambda ids, n: [i for i in ids if (4999 - i) % 3 == 1][:n]
    assert got == {(q, d): ((other(range(5000), 3) if d else other(dogs, 4)) if q == 599 else [0, 1, 2] if d else dogs[:4]) for q in range(600) for d in (True, False)}
    store.unpersist()


def test_asks_of_words_are_one_scan_with_floors(spark, monkeypatch):
    """More asks than were one scan before; what some chunks reach leaves nothing out, ties and small blocks included."""
    word = lambda i, j: "thecatdogowlantbee"[(k := (i * 5 + j * j + i // 7) % 6 * 3) : k + 3]
    docs = spark.createDataFrame([(i, None if i % 40 == 0 else " ".join([word(i, j) for j in range(i % 9)] + ["of"] * (i % 4 > 0))) for i in range(400)], "id long, text string")
    lists = [[["the"], ["cat"]], [["dog"], ["owl"], ["dog"]], [["of"]], [["of"], ["bee"], ["nothing"]], [["nothing"]], []]
    asks = spark.range(9000).select(F.col("id").alias("ask"), F.get(F.lit(lists), (F.col("id") % 6).cast("int")).alias("phrases"))
    want = sorted((r["qid"], r["id"], r["rank"], round(r["score"], 9)) for r in lexical.search(lexical.build(docs), asks.where("ask < 6").withColumnRenamed("ask", "qid"), n=3).collect())
    assert {q for q, *_ in want} == {0, 1, 2, 3}
    store = stored.rows(docs.repartition(3)).cache()
    for floors, rows in ((1 << 28, 1024), (0, 1024), (0, 8)):
        monkeypatch.setattr(stored, "FLOORS", floors, raising=False)
        monkeypatch.setattr(stored, "ROWS", rows)
        found = stored.lists(store, asks, dense=0, keyword=3)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        got: dict = {}
        for r in found.collect():
            got.setdefault(r["ask"], []).append((r["ask"] % 6, r["id"], r["rank"], round(r["value"], 9)))
        assert sorted(r for q in range(6) for r in got.get(q, [])) == want
        assert len(got) == 6000 and all(sorted(x) == sorted(got[q % 6]) for q, x in got.items())
    store.unpersist()


def test_chunks_are_dealt_out_before_their_terms_are_made(spark, tmp_path):
    """What is shuffled are the texts; a filing that is written again takes the place of the old one."""
    plans: list[str] = []
    with pytest.MonkeyPatch.context() as patch:
        write = stored.write
        patch.setattr(stored, "write", lambda made, *a, **b: (plans.append(made._jdf.queryExecution().optimizedPlan().toString()), write(made, *a, **b))[1])
        catalog.stored_replace(spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and all(0 <= p.find("ArrowEvalPython") < p.find("Rebalance") for p in plans)
    docs = spark.createDataFrame([(1, "a", "2025", "cat"), (2, "a", "2025", "dog"), (3, "b", "2024", "owl")], "id long, ticker string, year string, text string")
    made = stored.rows(stored.dealt(docs))
    stored.write(made, path := f"{tmp_path}/store", done=True)
    stored.write(stored.rows(stored.dealt(docs.where("id = 2"))), path, done=True)
    assert sorted((r["id"], r["terms"], r["year"]) for r in stored.read(spark, path, made).collect()) == [(2, ["dog"], "2025"), (3, ["owl"], "2024")]


def test_sums_in_quanta_leave_out_none_of_the_best():
    """Against all scores, over blocks, with floors, filters and ties."""
    import numpy as np
    import pyarrow as pa

    chance = np.random.default_rng(3)
    lists = [[[f"w{w}"] for w in chance.integers(0, 60, n)] for n in chance.integers(0, 30, 200)]
    p = stored._Phrases(pa.array(lists, pa.list_(pa.list_(pa.string()))))
    weights = chance.random(p.size) * 12 * (chance.random(p.size) < 0.8) + 1e-6
    table = np.where(chance.random((900, p.size)) < 0.3 * chance.random(p.size), weights * chance.choice([0.5, 1.0, 1.7], (900, p.size)), 0.0)
    table[chance.integers(0, 900, 300)] = table[7]
    kinds, keys = chance.random((3, p.asks)) < 0.7, chance.integers(0, 3, 900)
    of = np.zeros((p.size, p.asks))
    of[p.code, np.repeat(np.arange(p.asks), p.n)] = 1
    scores = np.where(kinds[keys], table @ of, 0)
    best = {q: sorted((-round(x, 9), i) for i, x in enumerate(scores[:, q]) if x > 0)[:5] for q in range(p.asks)}
    fifth = np.array([-x[4][0] - 1e-9 if len(x) > 4 else 0.0 for x in best.values()])
    for floor in (np.zeros(p.asks), fifth, fifth / 2):
        kept = stored._Kept(p, 5, floor)
        for at in range(0, 900, 300):
            here = slice(at, at + 300)
            r, code = np.nonzero(table[here])
            block = stored._Block(p, 300, r.astype(np.int32), code.astype(np.int32), table[here][r, code], kinds, keys[here])
            for q, x in block.sums():
                assert (abs(x * block.quantum - scores[here, q]) <= (p.n[q] + 1) * block.quantum).all()
            kept.meet(block, pa.array(np.arange(at, at + 300)))
        q, value, ids = kept.rows()
        got: dict = {k: [] for k in range(p.asks)}
        for k, x, i in zip(q.tolist(), value.tolist(), ids.to_pylist(), strict=True):
            got[k].append((-round(x, 9), i))
        assert {k: [i for _, i in sorted(x)] for k, x in got.items()} == {k: [i for _, i in x] for k, x in best.items()}


def test_batches_are_worked_on_in_parts():
    """What a worker holds besides its batch does not grow with the batch."""
    import tracemalloc

    import pyarrow as pa

    from vellumgrid.functions import models
    from vellumgrid.operators import chunking

    said = [None, "", *(f"Line {i} of it. More of {i}, a b c.\nTotal | {i}\n" * 40 for i in range(800))]
    texts, words = pa.array(said), pa.array([(t or "").split() for t in said])

    def peak(f, batch) -> int:
        f(batch.slice(0, 10))
        tracemalloc.start()
        f(batch)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    for f, batch, own in ((chunking.unit_lists, texts, 8 << 20), (models.embed_texts, texts, 4 << 20), (stored.term_lists, words, 40 << 20)):
        assert peak(f, batch) < own
        assert len(f(batch)) == len(batch) and len(f(batch.slice(0, 0))) == 0
    for row, ws in zip(stored.term_lists(words).to_pylist()[::50], words.to_pylist()[::50], strict=True):
        ends = [sum(row["counts"][:k]) for k in range(len(row["counts"]) + 1)]
        assert row["dl"] == len(ws) and {t: row["positions"][a:b] for t, a, b in zip(row["terms"], ends, ends[1:], strict=False)} == {t: [k for k, w in enumerate(ws) if w == t] for t in ws}
    assert [[(u["text"], u["tokens"]) for u in x] for x in chunking.unit_lists(texts.slice(0, 4)).to_pylist()] == [chunking.units(t) if t else [] for t in said[:4]]
    assert models.embed_texts(texts.slice(0, 3)).to_pylist() == [models.embed_one(t) for t in said[:3]]


def test_reports_hold_every_row(spark):
    import json

    rows = spark.range(2500, numPartitions=7).orderBy("id")
    assert [r["id"] for r in json.loads(tables.pretty(rows))] == list(range(2500))
    assert tables.markdown(rows, "T").splitlines()[4:] == [f"| {i} |" for i in range(2500)]
    assert len(json.loads(tables.pretty(rows, 5))) == 5


def test_raw_pages(spark, tmp_path):
    (tmp_path / "F" / "2025").mkdir(parents=True)
    (tmp_path / "F" / "2025" / "a.htm").write_bytes(b"<p>caf\xe9 ok")
    assert [tuple(r) for r in tables.raw_pages(spark, str(tmp_path)).collect()] == [("F", "2025", "a.htm", "<p>caf\ufffd ok")]


def test_quotes_of_any_length(spark):
    """Against a plain search, with keys that are broadcast and shuffled, in one block of quotes and several."""
    from vellumgrid.operators import evaluation

    texts = ["say hello world  now and then", None, "", "now\tnow now now now", "he said: hello\u00a0world", "say hello world  now and then"]
    quotes = ["hello world", "now", "o w", "world now and", "ay hello world now and th", "hello then", None, "say hello world now and then", "", " ", "ow no", "now now", "now now now", "d", "id: hello wo", "a b c d e f g h i j"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string")
    flat = lambda x: None if x is None else " ".join(x.split())
    want = sorted((i, j) for i, t in enumerate(map(flat, texts)) for j, q in enumerate(map(flat, quotes)) if t is not None and q is not None and q in t)
    for block in (100, 2):
        assert sorted(tuple(r) for r in evaluation.quoted(docs, items, block=block).collect()) == want
    for none in (items.where("quote is null"), items.limit(0)):
        assert evaluation.quoted(docs, none).count() == 0
    assert evaluation.quoted(docs.limit(0), items).count() == 0


def test_vectors_of_one_dimension(spark):
    from vellumgrid.functions import text

    rows = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert rows.select(text.of_dimension(F.col("v"), 2).alias("v")).first()["v"] == [1.0, 2.0]
    with pytest.raises(Exception, match="expected 3"):
        rows.select(text.of_dimension(F.col("v"), 3)).collect()


def test_ingest(spark, tmp_path):
    """Every status, a second run, a forced one, a replaced filing, and chunks that search finds."""
    from vellumgrid.plans import ingest

    path = str(tmp_path / "filings")
    body = lambda what: f"<p>x</p><p>Item 1. Business</p><p>{what}</p><p>Item 7. Discussion</p><p>more {what}</p>"
    pages = [("F", "2024", body("trucks")), ("F", "2025", "<p>no headings</p>"), ("GM", "2024", None), ("GM", "2025", body("cars")), ("X", "2025", body("unwanted"))]
    pages = spark.createDataFrame(pages, "ticker string, year string, html string")
    wanted = spark.createDataFrame([("F", "2024"), ("F", "2024"), ("F", "2025"), ("GM", "2024"), ("GM", "2025"), ("Z", "2025"), (None, "2025")], "ticker string, year string")
    told = lambda df: {(r["ticker"], r["year"]): (r["status"], r["chunks"]) for r in df.collect()}
    first = ingest.ingest(wanted, pages, path)
    assert told(first) == {("F", "2024"): ("loaded", 2), ("F", "2025"): ("failed", 0), ("GM", "2024"): ("missing", 0), ("GM", "2025"): ("loaded", 2), ("Z", "2025"): ("missing", 0)}
    assert {r["status"]: (r["n"], r["names"]) for r in ingest.summary(first).collect()}["missing"] == (2, "GM 2024, Z 2025")
    assert {r["error"] for r in first.where("status = 'failed'").collect()} == {ingest.NOTHING}
    assert set(told(ingest.ingest(wanted, pages, path)).values()) == {("skipped", 0), ("failed", 0), ("missing", 0)}
    # forced: one filing has a new page, one no longer any headings and stays as it was
    again = spark.createDataFrame([("F", "2024", body("lorries. " * 900)), ("GM", "2025", "<p>gone</p>")], pages.schema)
    forced = told(ingest.ingest(wanted.where("year IS NOT NULL AND ticker <> 'Z'"), again, path, force=True))
    assert forced[("GM", "2025")] == ("failed", 0) and forced[("F", "2024")][0] == "loaded" and forced[("F", "2024")][1] > 2
    store = spark.read.parquet(f"{path}/store")
    assert {r["ticker"]: r["n"] for r in store.groupBy("ticker").agg(F.count("*").alias("n")).collect()} == {"F": forced[("F", "2024")][1], "GM": 2}
    asks = spark.createDataFrame([(1, [["lorries"]]), (2, [["trucks"]]), (3, [["cars"]])], "ask int, phrases array<array<string>>")
    assert {(r["ask"], r["id"].split("-")[0]) for r in stored.lists(store, asks).collect()} == {(1, "F"), (3, "GM")}
    assert store.where("v IS NULL").count() == 0


def test_keyed_replacement_has_few_folders(spark, tmp_path):
    """Folders do not grow with the filings; what shares a bucket with a replaced filing stays."""
    path, schema = str(tmp_path / "keyed"), "text string, ticker string, year string"
    make = lambda of, what: spark.createDataFrame([(f"{what} {k} {i}", f"P{k}", "2024") for k in of for i in range(2)], schema)
    tables.replace_keyed(make(range(150), "old"), path)
    tables.replace_keyed(make(range(140, 300), "new"), path)
    tables.replace_keyed(make([], "none"), path)
    got = tables.read_partitions(spark, path, schema).select("text").collect()
    assert sorted(r["text"] for r in got) == sorted(f"{'old' if k < 140 else 'new'} {k} {i}" for k in range(300) for i in range(2))
    assert len({f.rsplit("/", 2)[1] for f in spark.read.parquet(path).inputFiles()}) <= tables.BUCKETS
    from vellumgrid.plans import ingest

    pages = spark.createDataFrame([(f"P{k}", "2024", "<p>x</p><p>Item 1. Business</p><p>Item 7. Discussion</p><p>more</p>") for k in range(100)], "ticker string, year string, html string")
    ingest.ingest(pages, pages, str(tmp_path / "filings"))
    assert len({f.rsplit("/", 2)[1] for f in spark.read.parquet(f"{tmp_path}/filings/store").inputFiles()}) <= tables.BUCKETS


def test_section_files_round_trip(spark, tmp_path):
    """Texts come back as they were, in the order of names; a rewrite touches its own sections only."""
    at = str(tmp_path / "sections")
    rows = [("A", "2024", "10", "ten\n"), ("A", "2024", "1A", "Risk:\n\nline two "), ("A", "2024", "1", ""), ("A", "0012", "1", None), ("B/C", "2024", "7", "naïve \u20ac\r\nend\n\n")]
    tables.write_sections(spark.createDataFrame(rows, "ticker string, year string, item string, text string"), at)
    read = lambda **k: [tuple(r) for r in tables.read_sections(spark, at, **k).collect()]
    want = [(*r[:3], r[3] or "") for r in (rows[3], rows[2], rows[0], rows[1], rows[4])]
    assert read() == want
    assert read(where="ticker = 'A' AND item > '1'") == want[2:4]
    tables.write_sections(spark.createDataFrame([("A", "2024", "10", "new")], "ticker string, year string, item string, text string"), at)
    assert read() == [(*r[:3], "new") if r[2] == "10" else r for r in want]
    plan = tables.read_sections(spark, at, where="ticker = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ticker" in plan


def test_lookup_tells_what_is_missing(spark):
    wanted = spark.createDataFrame([("aa", "2024"), ("BB", "2024"), ("CC", "2024"), (None, "2024"), ("aa", "2025")], "ticker string, year string")
    registry = spark.createDataFrame([("AA", 2, "Second"), ("AA", 1, "First"), ("bb", 3, None)], "ticker string, cik_str long, title string")
    names = spark.createDataFrame([("BB", "Bee")], "ticker string, name string")
    got = {(r.ticker, r.year): (r.cik_str, r.company, r.error) for r in tables.looked_up(wanted, registry, names).collect()}
    assert got == {
        ("aa", "2024"): (1, "First", None),
        ("aa", "2025"): (1, "First", None),
        ("BB", "2024"): (3, "Bee", None),
        ("CC", "2024"): (None, "CC", "ticker CC is not in the registry"),
        (None, "2024"): (None, None, "ticker (null) is not in the registry"),
    }
    assert tables.looked_up(wanted, registry.limit(0), names.limit(0)).where("error IS NULL").count() == 0


def test_quotes_are_proven_on_the_texts_that_met_one(spark):
    """Texts that met no quote are neither normalised again nor shuffled."""
    from vellumgrid.operators import evaluation

    docs = spark.createDataFrame([(k, f"some words  {k} that stand before the others here {k}") for k in range(50)], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "7 that stand before the others here 7"), (2, "nothing of this is in any of the texts")], "item_id long, quote string")
    found = evaluation.quoted(docs, quotes)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan
    assert [tuple(r) for r in found.collect()] == [(7, 1)]
    assert [tuple(r) for r in evaluation.quoted(docs, quotes, block=1).collect()] == [(7, 1)]
