"""Small models written by hand, against the library: unigram, user-defined and unused pieces, no
byte fallback, white space made tidy."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenmill.llm import sentencepiece_fst as spm

sentencepiece = pytest.importorskip("sentencepiece")


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model(pieces, kind, tidy=0, fallback=False, prefix=1):
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    rows += pieces
    out = b"".join(_field(1, _field(1, t.encode()) + _field(2, float(s)) + _field(3, k)) for t, s, k in rows)
    out += _field(2, _field(3, kind) + _field(4, len(rows)) + _field(35, int(fallback)))
    return out + _field(3, _field(1, b"identity") + _field(3, prefix) + _field(4, tidy) + _field(5, 1))


LETTERS = "abcxé"
UNIGRAM = [(p, s, 1) for p, s in [("a", -3.0), ("b", -3.25), ("▁", -2.0), ("ab", -4.0), ("▁a", -3.5), ("aba", -6.25), ("bb", -6.5), ("abab", -8.0), ("▁ab", -5.0), ("é", -4.0), ("ba", -6.25), ("xx", -3.0)]]
BPE = [(p, -float(i), 1) for i, p in enumerate(["ab", "▁a", "aa", "ba", "▁ab", "aab", "abab", "bb", "xa", "xab", "aaaa", "bab", "cc", "abc", "▁", "a", "b", "c", "é"])]
MODELS = {
    "unigram": model(UNIGRAM, 1),
    "unigram with bytes": model(UNIGRAM, 1, fallback=True),
    "unigram, user-defined": model([*UNIGRAM, ("xab", 0.0, 4), ("bba", -9.0, 5)], 1),
    "bpe": model(BPE, 2),
    "bpe with bytes, tidy": model(BPE, 2, tidy=1, fallback=True),
    "bpe, user-defined": model([*BPE, ("bc", 0.0, 4), ("cab", 0.0, 4)], 2, fallback=True),
    "bpe, unused": model([(p, s, 5 if p in ("ab", "abab") else k) for p, s, k in BPE], 2, fallback=True),
    "bpe without prefix": model(BPE, 2, prefix=0),
}


@pytest.mark.parametrize("name", MODELS)
@settings(max_examples=250, deadline=None)
@given(text=st.one_of(st.text(alphabet=LETTERS + " ▁\n", max_size=70), st.text(max_size=12)))
def test_ids_equal_the_library(name, text):
    fst, lib = _loaded(name)
    if "\0" not in text:
        assert fst.encode(text) == lib.encode(text)


_LOADED = {}


def _loaded(name):
    if name not in _LOADED:
        lib = sentencepiece.SentencePieceProcessor()
        lib.load_from_serialized_proto(MODELS[name])
        _LOADED[name] = spm.Transducer(MODELS[name]), lib
    return _LOADED[name]


def test_long_units_as_short_ones():
    for name in MODELS:
        fst, lib = _loaded(name)
        for text in ("abab" * 100, "aaaaabbabx" * 300, "xabxx" * 50 + " " + "ab" * 15):
            assert fst.encode(text) == lib.encode(text), name


def test_other_models_raise():
    for kind in (3, 4):
        with pytest.raises(ValueError):
            spm.Transducer(model(UNIGRAM, kind))
