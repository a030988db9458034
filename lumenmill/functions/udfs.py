"""Arrow-batched functions for what Spark has no expression for.

``clean_value``: HTML entities and NFKC. ``parse_timestamp``: ISO forms. ``normalise``: the whole
normaliser, whose case-changing and cascading replacements regexp_replace cannot do; it returns
the text, counters and an audit of dropped single letters.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from datetime import datetime

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

import lumenmill
from lumenmill.functions import fixed

cloudpickle.register_pickle_by_value(lumenmill)

_TEXT = T.StringType()
AUDIT = T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in ("left", "letters", "right")]))
NORMALISED = T.StructType([T.StructField("text", _TEXT), T.StructField("counters", T.MapType(_TEXT, T.IntegerType())), T.StructField("audit", AUDIT)])


def clean_text(value: str) -> str:
    """Entities once, NFKC, white space collapsed, one pair of enclosing quotes off."""
    value = " ".join(unicodedata.normalize("NFKC", html.unescape(value)).split())
    if len(value) >= 2 and value[0] == value[-1] == '"':
        value = value[1:-1].strip()
    return value


def iso_text(value: str | None) -> str | None:
    try:
        return datetime.fromisoformat(value.strip()).isoformat()
    except (AttributeError, ValueError):
        return None


class Normaliser:
    """The steps in their fixed order, with compiled patterns."""

    def __init__(self, simplify=None):
        self.simplify = simplify  # Traditional to Simplified Chinese, if there is a converter
        self.variants = str.maketrans(fixed.VARIANT_CHARS)
        self.phrases = re.compile("|".join(map(re.escape, sorted(fixed.PHRASES, key=len, reverse=True))))
        self.masks = [(name, re.compile(pattern)) for name, pattern in (("EMAIL", fixed.EMAIL), ("QQ", fixed.QQ), ("WECHAT", fixed.WECHAT), ("PHONE", fixed.PHONE), ("MONEY", fixed.MONEY))]
        self.url, self.url_words = re.compile(fixed.URL, re.I), re.compile(fixed.URL_WORDS)
        self.prefix, self.keep = re.compile(fixed.SUBJECT_PREFIX, re.I), re.compile(fixed.KEEP)
        self.spaced, self.between, self.zh_space = map(re.compile, (fixed.SPACED_ACRONYM, fixed.LETTERS_BETWEEN_ZH, fixed.ZH_SPACE))
        self.white = {"".join(c.upper() if c.isascii() else c for c in w) for w in fixed.LETTER_WHITELIST}
        long = sorted((w for w in self.white if len(w) >= 3 and w.isascii()), key=lambda w: (-len(w), w))
        self.acronyms = re.compile(r"(?<![A-Za-z])(?:" + "|".join(r"\s*".join(w) for w in long) + r")(?![A-Za-z])", re.I)

    def _phrase_passes(self, text: str) -> str:
        for _ in range(3):
            once = self.phrases.sub(lambda m: fixed.PHRASES[m[0]], text)
            if once == text:
                break
            text = once
        return text

    def _mask_urls(self, text: str, count: Counter) -> str:
        def put(m: re.Match) -> str:
            count["URL"] += 1
            words = [w.replace("-", " ").lower() for w in self.url_words.findall(m[0].rstrip(fixed.URL_TAIL))]
            return " ".join(["[URL]", *words])

        return self.url.sub(put, text)

    def _mask(self, name: str, pattern: re.Pattern, text: str, count: Counter) -> str:
        text, n = pattern.subn(f"[{name}]", text)
        count[name] += n
        return text

    def _joined(self, pattern: re.Pattern, name: str, text: str, count: Counter, changed_only: bool) -> str:
        def put(m: re.Match) -> str:
            word = "".join(m[0].split()).upper()
            count[name] += not changed_only or word != m[0]
            return word

        return pattern.sub(put, text)

    def _letters(self, text: str, count: Counter, audit: list[dict]) -> str:
        def put(m: re.Match) -> str:
            letters = "".join(m[0].split()).upper()
            right = text[m.end() : m.end() + 8]
            kept = letters in self.white or letters + right[:1] in self.white
            count["LETTER_KEPT" if kept else "LETTER_DROPPED"] += 1
            if not kept:
                audit.append({"left": text[max(0, m.start() - 8) : m.start()], "letters": m[0].strip(), "right": right})
            return f" {letters} " if kept else ""

        return self.between.sub(put, text)

    def __call__(self, text: str | None, subject: bool = False) -> dict | None:
        if not text:
            return None if text is None else {"text": "", "counters": {}, "audit": []}
        count, audit = Counter(), []
        if subject:
            bare = self.prefix.sub("", text)
            count["SUBJECT_PREFIX"] += bare != text
            text = bare.strip()
        if text:
            text = text.translate(self.variants)
            text = self._phrase_passes(self.simplify(text) if self.simplify else text)
            text = self._mask_urls(text, count)
            for name, pattern in self.masks:
                text = self._mask(name, pattern, text, count)
            text = self.zh_space.sub("", " ".join(self.keep.findall(text)))
            text = self._phrase_passes(text)
            text = self._mask(*self.masks[2], text, count)
            text = self._joined(self.spaced, "SPACED_ACRONYM", text, count, False)
            text = self._joined(self.acronyms, "KNOWN_ACRONYM", text, count, True)
            text = self.zh_space.sub("", self._letters(text, count, audit))
        return {"text": text, "counters": {k: int(v) for k, v in count.items() if v}, "audit": audit}


def _on_each(function):
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else function(v))

    return run


def _clean_lists(values: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else [clean_text(x) if t and x is not None else x for x, t in zip(v, yes, strict=True)] for v, yes in zip(values, text, strict=True)])


clean_values = F.pandas_udf(_clean_lists, T.ArrayType(_TEXT))
clean_value = F.pandas_udf(_on_each(clean_text), _TEXT)
parse_timestamp = F.pandas_udf(_on_each(iso_text), _TEXT)


def _normalise(subject: bool):
    def run(column: pd.Series) -> pd.DataFrame:
        step = Normaliser()
        out = [step(v, subject) or {"text": None, "counters": None, "audit": None} for v in column]
        return pd.DataFrame(out, columns=["text", "counters", "audit"])

    return F.pandas_udf(run, NORMALISED)


normalise = _normalise(False)
normalise_subject = _normalise(True)
