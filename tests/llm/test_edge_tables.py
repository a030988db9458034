"""Every registered query over whole odd tables: nulls anywhere, repeats, clashing extra columns,
and over empty tables."""

import pytest

import corpus_pipeline
from lumenmill.llm import registry

QUERIES = {**registry.QUERIES, "pipeline": corpus_pipeline.run}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    odd, empty = tmp_path_factory.mktemp("odd"), tmp_path_factory.mktemp("empty")
    text = "the quick brown fox jumps over the lazy dog and runs far away home"
    docs = [(1, text, "en", "a", 1, "x", "y"), (1, text, "en", "a", 1, "x", "y"), (2, None, None, None, None, None, None), (None, text.upper(), "en", None, 3, "x", None), (3, "", "fr", "b", 0, None, "y"), (4, " \t\n", None, "b", 3, "x", "y"), (None, None, None, None, None, None, None), (5, "é" * 70_000 + " mot", "fr", "b", 9, "x", "y"), (6, "a b", "fr", "a", 3, "x", "y")]
    labels = [(1, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 0), (6, 0, None)]
    vectors = [(0, [1.0, 0.0], 1), (50, [0.5, 0.5], None), (50, [0.5, 0.5], 2), (100, None, 1), (150, [0.0, 0.0], 1), (200, [float("nan"), 1.0], 1), (1, [0.0, 2.0], 3), (None, [1.0, 1.0], 1), (2, [1.0], 1)]
    pages = [(1, "http://a.example/", "<article><p>x &amp; y</p></article>"), (1, "http://a.example/", "<article><p>x &amp; y</p></article>"), (2, None, None), (None, "b", ""), (3, "http://a.example/2", "<<>><p")]
    for folder, keep in ((odd, True), (empty, False)):
        tables = {
            "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long, id string, key string"), "labels": (labels, "doc_id long, quality int, toxic int"),
            "embeddings": (vectors, "vec_id long, embedding array<float>, label int"), "pages": (pages, "page_id long, url string, html string"),
        }
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows if keep else [], schema).coalesce(2).write.parquet(str(folder / f"{name}.parquet"))
    return str(odd), str(empty)


ROWS = {"op1": 5, "op3": 9, "op4": 9, "op6": 9, "op7": 9, "op8": 9, "op10": 9}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(spark, folders, name):
    odd, empty = folders
    got = QUERIES[name](spark, odd).collect()
    if (want := ROWS.get(name.split("_")[0])) is not None:
        assert len(got) == want
    else:
        assert got
    assert QUERIES[name](spark, empty).collect() == []
