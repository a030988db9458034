"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from lumenmill.plans import classify, corpus, files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (classify, corpus, files):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
