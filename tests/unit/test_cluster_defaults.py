"""The clustering queries run the reference's own sizes."""

import inspect

from lumenmill.operators import cluster
from lumenmill.plans import corpus


def test_sizes(monkeypatch):
    calls = {}

    def spy(name, result):
        wanted = inspect.signature(getattr(cluster, name))

        def called(*args, **kw):
            bound = wanted.bind(*args, **kw)
            bound.apply_defaults()
            calls.setdefault(name, []).append(bound.arguments)
            return result

        monkeypatch.setattr(cluster, name, called)

    class Frame:
        def __getattr__(self, name):
            return lambda *a, **k: self

    class Column(Frame):
        def __eq__(self, other):
            return self

    frame = Frame()
    spy("kmeans", (frame, None))
    for name in ("reduce_dimensions", "sparse_rows", "scan_k", "nearest_samples", "with_empty", "suggest_names", "cluster_keywords"):
        spy(name, frame)
    monkeypatch.setattr(cluster, "pick_k", lambda scan: 8)
    monkeypatch.setattr(corpus.F, "col", lambda name: Column())
    monkeypatch.setattr(corpus, "_vectors", lambda s, d: frame)
    monkeypatch.setattr(corpus.tfidf, "vocabulary", lambda w: frame)
    features = []
    monkeypatch.setattr(corpus, "_weights", lambda s, d, **kw: features.append(kw["max_features"]) or (frame, frame))
    for query in ("kmeans_labels", "kmeans_nearest_samples", "kmeans_scan", "svd_cluster_names"):
        corpus.QUERIES[query](None, "")
    assert [(c["seeds"], c["max_iter"]) for c in calls["kmeans"]] == [(10, 300)] * 3
    assert [(c["seeds"], c["max_iter"], c["ks"]) for c in calls["scan_k"]] == [(3, 100, corpus.KS)] and corpus.KS == [8, 10, 12, 15, 18, 20, 25, 30]
    assert features == [50_000] and calls["reduce_dimensions"][0]["components"] == 100
