"""The stored vector index: recall against the exact search, with and without a filter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.sources import vector_index
from tidewell.sources.vector_index import VectorIndex, kmeans


def brute(ids, vectors, q, k, passing):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    score = u @ u[q]
    order = [i for i in np.lexsort((ids, -score)) if passing[i] and i != q][:k]
    return {int(ids[i]): score[i] for i in order}


@pytest.mark.parametrize("kind", ["clusters", "sphere"])
def test_recall_with_and_without_a_filter(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 300)
    monkeypatch.setattr(vector_index, "QUERIES", 20)
    rng = np.random.default_rng(1)
    n, d = 3000, 24
    vectors = rng.normal(size=(n, d)) + (4 * rng.normal(size=(30, d))[rng.integers(0, 30, n)] if kind == "clusters" else 0)
    ids, label = rng.permutation(n), rng.integers(0, 20, n)
    rows = spark.createDataFrame([(int(i), [float(x) for x in v], int(x)) for i, v, x in zip(ids, vectors, label)], "vec_id long, embedding array<double>, label int").repartition(4)
    index = VectorIndex(spark, str(tmp_path / "index"))
    model = index.build(rows.where("vec_id < 2600"), "vec_id", "embedding", sample=1500)
    index.add(rows.where("vec_id >= 2600"), "vec_id", "embedding")
    assert index.rows().count() == n and len(model.centres) > 10
    assert kind == "sphere" or model.probes <= len(model.centres) // 3
    queries = rows.where("vec_id % 50 = 0")
    for where, passing in ((None, np.ones(n, bool)), (F.col("label") == 3, label == 3)):
        got = {}
        for r in index.search(queries, "vec_id", "embedding", k=10, ef=100, where=where, apart=True).collect():
            got.setdefault(r.query, []).append((r["rank"], r.id, r.score))
        hits = []
        for i in np.flatnonzero(ids % 50 == 0):
            want, mine = brute(ids, vectors, i, 10, passing), sorted(got[int(ids[i])])
            assert [x for x, _, _ in mine] == list(range(1, 11)) and all(passing[ids == j][0] for _, j, _ in mine)
            assert all(abs(want[j] - s) < 1e-9 for _, j, s in mine if j in want)
            hits.append(len(want.keys() & {j for _, j, _ in mine}) / 10)
        assert np.mean(hits) >= 0.9


def test_few_and_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 1.0]), (5, [1.0, 1.0])], "vec_id long, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(rows, "vec_id", "embedding")
    found = index.search(rows.where("vec_id = 1"), "vec_id", "embedding", k=10).collect()
    assert [(r.id, round(r.score, 6)) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1.0), (5, 0.707107), (2, 0.0)]


def test_centres_are_never_empty():
    x = np.array([[0.0]] * 10 + [[5.0]] * 3 + [[9.0]])
    assert sorted(kmeans(x, 3, np.random.default_rng(0)).ravel().round(6)) == [0.0, 5.0, 9.0]
