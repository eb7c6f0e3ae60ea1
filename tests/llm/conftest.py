import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra
    columns whose names the operators use inside."""
    long = "The quick brown fox jumps over the lazy dog. " * 3000
    rows = [(1, None, "en"), (2, "", "en"), (3, "Re.", None), (None, "no id at all here", "en"), (5, long, "en"), (5, long, "en"), (6, "123 456 !!", "de"), (7, "Mot étrange, naïve façade", "fr"), (8, "\t\n  ", None), (9, "<|endoftext|> x  y\n\nz", "en")]
    docs = spark.createDataFrame([(*r, 0, 0, "x", [1], 2.5, "k", 9) for r in rows], "doc_id long, text string, lang string, row int, fp int, words string, licences array<int>, score double, item string, held_out int")
    return docs


@pytest.fixture(scope="session")
def edge_dir(spark, edge_docs, tmp_path_factory):
    """A table folder with the edge cases, and one with empty tables."""
    base = tmp_path_factory.mktemp("edge")
    vectors = [(0, [0.5, 0.25], 1), (50, [0.5, 0.25], 1), (1, None, 1), (2, [float("nan"), 1.0], 1), (3, [None, 1.0], 1), (4, [1.0], 1), (None, [1.0, 1.0], 1), (7, [0.5, 0.25], 1), (7, [0.5, 0.25], 1), (8, [-1.0, 0.1], 0)]
    parts = {
        "documents": edge_docs,
        "labels": spark.createDataFrame([(5, 1, 0), (6, 0, 1), (7, 1, None), (None, 0, 1), (8, None, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog the quick brown fox"), (2, None), (3, ""), (None, "a b c d e f g")], "item_id long, text string"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"),
    }
    for name, df in parts.items():
        df.write.parquet(os.path.join(base, "full", f"{name}.parquet"))
        df.limit(0).write.parquet(os.path.join(base, "empty", f"{name}.parquet"))
    return base
