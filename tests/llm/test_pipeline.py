"""The corpus pipeline on the smallest tables and on edge cases."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    before = spark.read.parquet(f"{SF}/documents.parquet")
    kept = out.select("doc_id").distinct()
    assert out.columns == [*before.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() == kept.count() < before.count()
    texts = before.join(kept, "doc_id", "left_semi").select("text")
    assert texts.distinct().count() == texts.count()  # no exact copies are left


def test_edge_cases(spark, edge_dir):
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"{edge_dir}/full").select("doc_id").collect()} <= {None, 3, 5, 7, 9}
    assert corpus_pipeline.run(spark, f"{edge_dir}/empty").count() == 0


def clashing(docs):
    """With columns that have the names of what stages make."""
    return docs.selectExpr("*", "1 as p", "'x' as P_", "7 as n_tokens", "'k' as score", "'l' as lang_pred", "3 as same", "4 as digest")


def check(docs, out, kept, extra=()):
    """The rows of ``kept`` doc_ids with all their columns."""
    own = [c for c in docs.columns if c not in extra]
    key = lambda r: str(tuple(r[c] for c in own))
    assert sorted(map(key, out.collect())) == sorted(key(r) for r in docs.collect() if r["doc_id"] in kept)


def test_language_stage(spark, tmp_path):
    rows = [(i, "the cat and the dog of the house" if i % 2 else "der hund und die katze im haus", "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 - 34", None), (103, "the dog", None), (None, "und die katze", None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    check(docs, corpus_pipeline.language_id(spark, docs, ""), {*range(40), 103, None})
    assert corpus_pipeline.language_id(spark, docs.limit(0), "").count() == 0


def test_quality_stage(spark, tmp_path):
    good, bad = "Plain words in a row, and a few more of them. ", "BUY!! NOW!! $$$ "
    docs = clashing(spark.createDataFrame([(i, (good if i % 2 else bad) * 20) for i in range(60)] + [(60, None), (60, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    got = corpus_pipeline.quality_filter(spark, docs, f"{tmp_path}/a")
    check(docs.where("doc_id < 60"), got.where("doc_id < 60"), set(range(1, 60, 2)))
    assert got.where("doc_id = 60").count() in (0, 2)
    check(docs, corpus_pipeline.quality_filter(spark, docs, f"{tmp_path}/b"), set(range(61)))


def test_near_dedup_stage(spark):
    words = [f"w{i}" for i in range(60)]
    copies = [(i, " ".join(words)) for i in (9, 3, 5)] + [(4, " ".join([*words, "more"])), (3, " ".join(words)), (None, " ".join(words)), (7, "else"), (8, None), (2, "")]
    docs = clashing(spark.createDataFrame(copies, "doc_id long, text string"))
    check(docs, corpus_pipeline.near_dedup(spark, docs, ""), {3, None, 7, 2})
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_decontamination_stage(spark, tmp_path):
    item = "how many apples does the farmer sell when the market opens at noon on sunday"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(spark.createDataFrame([(1, f"so {item} then"), (2, "nothing of it"), (3, None), (None, item), (4, "")], "doc_id long, text string"))
    check(docs, corpus_pipeline.decontamination(spark, docs, str(tmp_path)), {2, 3, None, 4})


def test_byte_bpe_stage(spark):
    docs = clashing(spark.createDataFrame([(1, "some text"), (2, None), (2, None)], "doc_id long, text string"))
    out = corpus_pipeline.byte_bpe(spark, docs, "")
    assert [c for c in out.columns if c == "n_tokens"] == ["n_tokens"] and {r["n_tokens"] for r in out.collect()} == {2, 0}
    check(docs, out, {1, 2}, ("n_tokens",))


def test_a_worker_gives_back_what_a_task_freed():
    """After near_dedup's tasks idle workers stand beside the executor, so they may not keep what they have freed."""
    import re
    from pathlib import Path

    import numpy as np
    import pyarrow as pa

    from vellumgrid.llm.common import lean

    own = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    before, held = own(), []

    def work(batches):
        held.extend(bytes(900) for _ in range(200_000))
        kept = [np.ones(20) for _ in range(1000)]
        yield from batches
        del held[:], kept

    assert list(lean(work)(iter([batch]))) == [batch]
    assert own() < before + 60


def test_the_words_a_language_model_keeps_are_bounded():
    import numpy as np

    from vellumgrid.llm.langid import Model

    model = Model(["de", "en", "es", "fr"], [{}, {}], floors=np.zeros((2, 4)), starts=np.zeros(1, np.int64), whose=np.zeros(0, np.int32), gains=np.zeros(0, np.float32))
    for k in range(150_000):
        model.unseen(f"w{k}")
    assert len(model.cache) < 130_000
