"""The jobs over growing input, broken-off runs and edge cases, on copies of the given tables."""

import logging
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import evaluate_retrieval, index_new, queries
from vellumgrid.operators import stored

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(rows):
    return sorted(tuple("" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert plain(df.collect()) == plain(want.project(", ".join(f'"{c}"' for c in df.columns)).fetchall())


def told(df):
    return {r["doc_id"]: r for r in df.collect()}


def add(spark, path, rows):
    made = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, source string, lang string, status string, batch int")
    made.coalesce(1).write.mode("append").parquet(path)


def test_index_takes_only_what_is_new(spark, tmp_path, caplog):
    docs, out, at = (f"file://{tmp_path}/{x}" for x in ("docs", "out", "at"))
    caplog.set_level(logging.INFO, logger="index_new")
    add(spark, docs, [(1, "one fish two fish", "a", "en"), (2, None, "a", "en"), (3, "?!", "b", "en"), (4, "old text", "", None), (None, "no id", None, "en"), (5, "twice b", "a", "en"), (5, "twice a", "a", "en")])
    first = told(index_new.run(spark, docs, out, at))
    assert {i: r["status"] for i, r in first.items()} == {1: "loaded", 2: "missing", 3: "failed", 4: "loaded", None: "loaded", 5: "loaded"}
    assert first[1]["terms"] == "fish:2 one:1 two:1" and first[1]["words"] == 4 and first[1]["year"] == "2025"
    assert first[4]["ticker"] is None and first[2]["terms"] is None
    again = told(index_new.run(spark, docs, out, at))  # nothing new
    assert again == first and spark.read.parquet(f"{out}/log").agg(F.max("batch")).first()[0] == 0

    # changed, the same again, lost its text, new
    add(spark, docs, [(4, "new text here", "c", "fr"), (1, "one fish two fish", "a", "en"), (5, None, "a", "en"), (6, "six", "a", "de")])
    caplog.clear()
    second = told(index_new.run(spark, docs, out, at))
    assert "batch 1: read 4 rows" in caplog.text and "loaded 2 documents" in caplog.text
    assert {i: r["status"] for i, r in second.items()} == {1: "skipped", 2: "missing", 3: "failed", 4: "loaded", None: "loaded", 5: "missing", 6: "loaded"}
    assert second[4]["terms"] == "here:1 new:1 text:1" and second[4]["ticker"] == "c" and second[1]["terms"] == first[1]["terms"] and second[5]["terms"] == first[5]["terms"]
    assert {r["batch"]: r["n"] for r in index_new.index(spark, out).groupBy("batch").agg(F.count("*").alias("n")).collect()} == {0: 4, 1: 2}

    # a batch that comes again, as after a crash, overwrites itself
    batch = spark.read.parquet(docs).where("doc_id IN (1, 4, 5, 6)")
    fresh = spark.createDataFrame([(4, "new text here", "c", "fr"), (1, "one fish two fish", "a", "en"), (5, None, "a", "en"), (6, "six", "a", "de")], batch.select("doc_id", "text", "source", "lang").schema)
    index_new.land(fresh, 1, out, 2024, 3)
    assert told(index_new.current(spark, out)) == second

    # what stands there is a store for retrieval, with the statistics of the newest documents
    asks = spark.createDataFrame([(1, [["text"], ["fish"]])], "ask int, phrases array<array<string>>")
    rebuilt = stored.rows(spark.createDataFrame([(1, "one fish two fish"), (4, "new text here"), (None, "no id"), (5, second[5]["terms"].replace(":1", "")), (6, "six")], "id long, text string"))
    key = lambda df: sorted((r["id"], round(r["value"], 9), r["rank"]) for r in df.collect())
    assert key(stored.lists(index_new.live(spark, out), asks)) == key(stored.lists(rebuilt, asks)) != []


def test_many_small_batches_give_the_same(spark, tmp_path):
    docs, whole, parts = (f"{tmp_path}/{x}" for x in ("docs", "whole", "parts"))
    spark.read.parquet(f"{SF}/documents.parquet").repartition(4).write.parquet(docs)
    one = told(index_new.run(spark, docs, f"{whole}/out", f"{whole}/at"))
    many = told(index_new.run(spark, docs, f"{parts}/out", f"{parts}/at", max_files=1))
    assert one == many and len(one) == 200
    assert spark.read.parquet(f"{parts}/out/log").select("batch").distinct().count() == 4


def test_an_empty_table(spark, tmp_path):
    docs, items = f"{tmp_path}/docs", f"{tmp_path}/items"
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(docs)
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(items)
    assert index_new.run(spark, docs, f"{tmp_path}/out", f"{tmp_path}/at").collect() == []
    got = evaluate_retrieval.run(spark, docs, items, f"{tmp_path}/eval").collect()
    assert len(got) == 40 and {(r["kind"], r["retrieved"], r["of_kind"]) for r in got} == {("no_answer", "", None)}


def test_evaluation(spark, tmp_path):
    """Found at the second rank, all of two found, evidence that is not retrieved, none at all, no words."""
    texts = [(1, "red fox red fox red fox jumps"), (2, "a quick red fox  jumps far away over the hill and the dale"), (3, "blue whale sings"), (4, "say blue whale sings again"), (5, None), (6, ""), *((10 + i, "lone star") for i in range(7)), (30, "lone star " + "word " * 300)]
    items = [(1, "quick red fox jumps"), (2, "blue  whale sings"), (3, "green bird"), (4, None), (5, "??"), (6, "star word")]
    spark.createDataFrame([(i, t, "s", "en") for i, t in texts], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/items")
    runs = [sorted(evaluate_retrieval.run(spark, f"{tmp_path}/docs", f"{tmp_path}/items", f"{tmp_path}/out", 3, 4).collect(), key=lambda r: r["item_id"]) for _ in range(2)]
    assert runs[0] == runs[1]
    got = {r["item_id"]: r for r in runs[0]}
    assert [got[i]["kind"] for i in range(1, 7)] == ["long", "short", "no_answer", "no_answer", "no_answer", "short"]
    assert got[1]["quote_found"] and got[1]["hit_all"] and got[1]["n_holding"] == 1
    assert got[2]["retrieved"] == "3,4" and got[2]["first_rank"] == 1 and got[2]["hit_all"] and got[2]["n_holding"] == 2
    assert got[3]["retrieved"] == got[4]["retrieved"] == got[5]["retrieved"] == "" and not got[3]["quote_found"]
    rates = {r["kind"]: r for r in spark.read.json(f"{tmp_path}/out/rates").collect()}
    assert set(rates) == {"all", "long", "short"} and rates["all"]["questions"] == 3
    by = {k: [r for r in got.values() if r["kind"] == k or k == "all" and r["kind"] != "no_answer"] for k in rates}
    for k, own in by.items():
        assert rates[k]["quote_found"] == round(100 * sum(r["quote_found"] for r in own) / len(own), 1)
        assert rates[k]["reciprocal_rank"] == round(sum(1 / r["first_rank"] if r["first_rank"] else 0 for r in own) / len(own), 3)


def test_configs(spark):
    from vellumgrid.sources.tables import read_config

    assert read_config(spark, f"{ROOT}/jobs/index_new.json") == {"max_files": 1000, "first_year": 2024, "years": 3}
    assert read_config(spark, f"{ROOT}/jobs/evaluate_retrieval.json") == {"k": 5, "long_words": 20}
