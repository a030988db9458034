"""Rows that doc_id can't single out."""

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_row_of_each_group_stays(spark):
    base = "the quick brown fox jumps over the lazy dog and then runs far away to its home under the old tree by the river"
    near, other = base + " today", "some other words that are not like those at all and go on"
    rows = [(1, base), (1, base), (1, other), (None, base), (None, other), (None, near), (None, "alone"), (None, "alone"), (7, near + " too"), (8, "eight"), (8, "acht")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert exact.columns == docs.columns
    left = sorted((str(r.doc_id), r.text) for r in exact.collect())
    assert left == sorted([("1", base), ("1", other), ("None", near), ("None", "alone"), ("7", near + " too"), ("8", "eight"), ("8", "acht")])
    found = corpus_pipeline.drop_near_copies(spark, exact, "")
    assert found.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in found.collect()) == sorted([("1", other), ("7", near + " too"), ("None", "alone"), ("8", "eight"), ("8", "acht")])
