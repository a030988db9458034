"""Near de-duplication over many partitions writes as few files as its rows need, and finds the same groups."""

import numpy as np
import pytest

from lumenmill.llm import graph, near_dedup
from lumenmill.llm.common import files, stage

SETTINGS = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def wide(spark):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_files_for_few_rows(wide, monkeypatch):
    written = {}

    def counted(df, name, *most):
        out = stage(df, name, *most)
        written[name] = max(written.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(near_dedup, "stage", counted)
    monkeypatch.setattr(graph, "stage", counted)
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    rng = np.random.default_rng(3)
    bases = [list(rng.integers(0, 500, 90)) for _ in range(30)]
    texts = {}
    for i in range(240):
        words = list(bases[i % 30])
        words[int(rng.integers(0, 90))] = int(rng.integers(0, 500))
        words[i // 30 * 11] = 600 + i
        texts[i] = " ".join(f"w{w}" for w in words)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(86)} for i, t in texts.items()}
    low = {i: i for i in texts}
    moved = True
    while moved:
        moved = False
        for a in texts:
            for b in range(a % 30, a, 30):
                both = len(sets[a] & sets[b])
                if low[a] != low[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    low[a] = low[b] = min(low[a], low[b])
                    moved = True

    result = near_dedup.near_dedup(wide.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in result.collect()} == low
    most = files(wide, 0)
    assert most < 31
    assert {"near-classes", "near-shared", "near-buckets", "near-texts", "near-pairs", "near-open", "components", "near-components"} <= set(written)
    assert max(written.values()) <= most, written
    assert result.rdd.getNumPartitions() <= most
