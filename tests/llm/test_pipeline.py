"""The pipeline's stages on small tables, against plain Python."""

import random
import re

import corpus_pipeline
from lumenmill.llm import registry

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents():
    rng = random.Random(11)
    sounds = {"aa": ["ba", "na", "ka", "ra"], "oo": ["zo", "lo", "mo", "po"]}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(4)) for _ in range(n))
    rows = [(i, say("aa" if i % 2 else "oo", 40), "aa" if i % 2 else "oo", f"s{i % 4}") for i in range(80)]
    rows += [(100 + i, rows[3][1].replace(" ", "  " if i else "\n", 1), "aa", "s1") for i in range(3)]
    for i in range(3):
        w = rows[5][1].split()
        w[10 + i] = "banakara"
        rows.append((200 + i, " ".join(w), "aa", "s1"))
    rows += [(300, "12345 !!", None, "s0"), (301, None, None, None), (302, "", "aa", "s0")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages(spark, tmp_path):
    rows = _documents()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs, after = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
        after.append(docs.collect())
    ids = [sorted(r.doc_id for r in rows_) for rows_ in after]
    clean = [r[0] for r in rows if re.search("[a-z]", r[1] or "")]
    assert ids[0] == sorted(clean)
    assert ids[1] == sorted(set(clean) - {100, 101, 102})
    assert ids[2] == sorted(set(clean) - {100, 101, 102, 200, 201, 202})
    assert set(ids[3]) <= set(ids[2]) and 0.6 * len(ids[2]) < len(ids[3]) < 1.5 * len(ids[2])
    assert ids[4] == ids[3] and all(r.round_trip for r in after[4])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids[4]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert [n.split("_")[0] for n in sorted(registry.QUERIES, key=lambda n: int(n.split("_")[0][2:]))] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.ORACLES) <= set(registry.QUERIES)
