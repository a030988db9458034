"""Queries opN_<name> of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from lumenmill.llm import ann, exact_dedup, hpyp, html_extract, language_id, mixing, near_dedup, quality, sentencepiece_fst, substring_dedup

_MODULES = [ann, hpyp, html_extract, mixing, exact_dedup, language_id, near_dedup, substring_dedup, quality, sentencepiece_fst]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= getattr(_m, "ORACLES", {})
