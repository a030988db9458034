"""Texts of no learned language are rejected; clean short ones stay."""

import base64
import random

from pyspark.sql import functions as F

from lumenmill.llm import language_id
from lumenmill.llm.common import prepare


def test_foreign_scripts_and_noise(spark):
    prepare(spark)
    rng, rows = random.Random(7), []
    pieces = {"en": "th he in er an re on at en nd ing ion the and of to", "de": "sch ein ich der die und ung ver ge keit heit en", "fr": "es le la de ent que ou eau ai er é è ment tion"}
    pieces = {k: v.split() for k, v in pieces.items()}
    word = lambda p: "".join(rng.choice(p) for _ in range(rng.randrange(1, 5)))
    for lang, p in pieces.items():
        vocabulary = [word(p) for _ in range(1500)]
        for i in range(200):
            n = rng.choice([1, 3, 8, 40, 200])
            rows.append((len(rows), " ".join(rng.choice(vocabulary) if rng.random() < 0.8 else word(p) for _ in range(n)), lang))
    clean = len(rows)
    script = lambda a, b, n: " ".join("".join(chr(rng.randrange(a, b)) for _ in range(rng.randrange(3, 9))) for _ in range(n))
    for n in (8, 50, 300):
        for _ in range(5):
            noise = [script(0x4E00, 0x9FA5, n), script(0x430, 0x450, n), script(0x627, 0x64A, n), base64.b64encode(rng.randbytes(6 * n)).decode(), " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(n))]
            rows += [(len(rows) + i, t, None) for i, t in enumerate(noise)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs), F.lit(False)).collect()}
    assert [i for i in range(clean) if got[i].rejected] == []
    assert [i for i in range(clean, len(rows)) if not got[i].rejected] == []
