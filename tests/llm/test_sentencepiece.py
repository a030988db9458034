import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenmill.llm import sentencepiece_fst as spm

sentencepiece = pytest.importorskip("sentencepiece")
FST = spm.load()
LIB = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="ab the in\n ▁on.,é1", max_size=60)))
def test_ids_equal_the_library(text):
    assert list(FST.encode(text)) == LIB.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    assert FST.decode(list(FST.encode(text))) == text.replace("▁", " ")


def test_table(spark):
    docs = spark.createDataFrame([(1, "Hello  world\n", "x"), (2, "", "y"), (3, None, "z"), (None, "日本 🦙", "w"), (1, "Hello  world\n", "x"), (5, "long " * 40_000, "v")], "doc_id long, text string, ids string")
    got = spm.encode(docs).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[3].ids is None and by[3].n_pieces is None and by[2].ids == [] and by[1].ids == LIB.encode("Hello  world\n")
    assert all(r.round_trip for r in got if r.doc_id != 3) and by[5].n_pieces == len(LIB.encode("long " * 40_000))
    back = spm.decode(spm.encode(docs)).collect()
    assert {r.doc_id: r.text for r in back}[5] == "long " * 40_000
    assert spm.encode(docs.limit(0)).count() == 0
