"""What a Python worker holds at once doesn't grow with the batch, and its rows don't depend on where batches are cut."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lumenmill.llm import language_id, near_dedup, textkit
from lumenmill.llm import sentencepiece_fst as spm

FST = spm.load()


def batch_of(texts: int, words: int, names: list[str]) -> pa.RecordBatch:
    """Texts of some six bytes a word; the columns but for the last, the text, are numbers."""
    rng = np.random.default_rng(7)
    known = np.array(["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3000)])
    made = [" ".join(known[rng.integers(0, len(known), words)]) for _ in range(texts)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(texts))] * (len(names) - 1) + [pa.array(made)], names)


def peak_of(run, batch: pa.RecordBatch) -> float:
    """The most MB that arrays and objects take while the batch is done."""
    for _ in run([batch.slice(0, 1)]):  # what is made once
        pass
    tracemalloc.start()
    for _ in run([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_encoding_holds_a_block():
    assert peak_of(spm._encoder(FST), batch_of(60, 12_000, ["id", "text"])) < 80


def test_signing_holds_a_block():
    assert peak_of(near_dedup._sign, batch_of(60, 12_000, ["id", "key", "text"])) < 46


def test_counting_holds_few_texts():
    buffer = textkit.text_buffer(batch_of(language_id.ROWS, 100, ["id", "text"]).column("text"))

    def run(_):
        yield language_id.gram_counts(*buffer)

    assert peak_of(run, batch_of(2, 2, ["id", "text"])) < 45


def test_counts_do_not_depend_on_parts(monkeypatch):
    made = batch_of(40, 300, ["id", "text"]).column("text").to_pylist()
    data, offsets = textkit.text_buffer(pa.array([*made[:20], "", "é", None, *made[20:], ""]))
    got = []
    for most in (1 << 20, 16, 1):
        monkeypatch.setattr(language_id, "COUNTED", most, raising=False)
        got.append(language_id.gram_counts(data, offsets))
    assert len(got[0]) == 44 and (got[0] == got[1]).all() and (got[0] == got[2]).all()


def test_rows_do_not_depend_on_blocks(monkeypatch):
    batch, texts = batch_of(40, 700, ["id", "text"]), ["", "日本 " * 900, "a" * 5000, "  x▁y \n" * 800]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(44)), pa.array(batch.column("text").to_pylist() + texts)], ["id", "text"])
    got = []
    for size, keys in ((1 << 30, 1 << 30), (5000, 777), (1, 1000)):
        monkeypatch.setattr(spm, "BLOCK_BYTES", size)
        monkeypatch.setattr(spm, "SLICE", keys, raising=False)
        got.append([r for out in spm._encoder(FST)([batch]) for r in out.to_pylist()])
    assert len(got[0]) == 44 and got[0] == got[1] == got[2]
