"""The reduced space is that of a plain SVD, and Python makes the matrix once."""

import numpy as np
import pytest

from lumenmill.operators import cluster


def test_reduced_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((40, 130)) * (rng.random((40, 130)) < 0.3), 3)
    weights = spark.createDataFrame([(int(i), f"t{j:03}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "record_id int, token string, tfidf double")
    index = spark.createDataFrame([(f"t{j:03}", j) for j in range(130)], "token string, idx int")
    made, plain = [], cluster.IndexedRowMatrix
    monkeypatch.setattr(cluster, "IndexedRowMatrix", lambda rows: made.append(plain(rows)) or made[-1])
    got = {r.record_id: r.features.toArray() for r in cluster.reduce_dimensions(cluster.sparse_rows(weights, index), 6).collect()}
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :6] * s[:6]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array([got[i] for i in range(40)])
    assert got @ got.T == pytest.approx(want @ want.T, abs=1e-8)
    assert made[0]._java_matrix_wrapper._java_model.rows().getStorageLevel().useMemory()
