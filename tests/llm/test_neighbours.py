"""Learned partitions: recall against brute force, exact scores, hot vectors, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import neighbours
from tidewell.llm.neighbours import balanced_parts, fill, fit, neighbour_graph, search

SCHEMA = "id long, vector array<float>"


def table(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], SCHEMA).repartition(4)


def brute(ids, vectors, q, k):
    vectors = np.float32(vectors).astype(float)
    d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if i != q][:k]
    return [(int(ids[i]), d[i]) for i in order]


def answers(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    return {q: [x[1:] for x in sorted(rows)] for q, rows in out.items()}


def mean_recall(got, ids, vectors, k):
    total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        want = brute(ids, vectors, i, k)
        mine = got[int(ids[i])]
        exact = dict(brute(ids, vectors, i, len(ids)))
        assert len(mine) == min(k, len(ids) - 1) and all(abs(exact[j] - d) < 1e-9 for j, d in mine)
        assert mine == sorted(mine, key=lambda x: (x[1], x[0]))
        total += len({j for j, _ in want} & {j for j, _ in mine}) / len(want)
    return total / (ids % 20 == 0).sum()


@pytest.mark.parametrize("kind", ["clusters", "sphere"])
def test_recall(spark, kind):
    rng = np.random.default_rng(1)
    n, d = 3000, 16
    vectors = rng.normal(size=(n, d)) + (5 * rng.normal(size=(24, d))[rng.integers(0, 24, n)] if kind == "clusters" else 0)
    ids = rng.permutation(n)
    probes = []
    kept = neighbours.fit
    neighbours.fit = lambda *a, **k: (r := kept(*a, **k), probes.append((r.probes, r.parts)))[0]
    try:
        got = answers(search(table(spark, ids, vectors), F.col("id") % 20 == 0, k=10, sample=2000, parts=24, per_part=50))
    finally:
        neighbours.fit = kept
    assert mean_recall(got, ids, vectors, 10) >= 0.9
    assert probes[0][1] == 24 and (kind == "sphere" or probes[0][0] <= 8)  # structure is learned where there is some


def test_parts_are_balanced_and_cut_few_edges(spark):
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(1200, 8)) + 4 * rng.normal(size=(12, 8))[rng.integers(0, 12, 1200)]
    near = neighbour_graph(spark, sample, 8)
    exact = ((sample[:, None] - sample[None]) ** 2).sum(axis=2)
    np.fill_diagonal(exact, np.inf)
    assert all(set(a) == set(b) for a, b in zip(near.tolist(), np.argsort(exact, axis=1)[:, :8].tolist()))
    part = balanced_parts(sample, near, 12, rng)
    assert np.bincount(part, minlength=12).max() <= math.ceil(1.05 * 100)
    assert (part[near] == part[:, None]).mean() > 3 * (1 / 12)
    assert sorted(np.bincount(fill(rng.random((100, 4)), 25)).tolist()) == [25] * 4


def test_hot_vector_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERIES", 8)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 6))
    vectors[:400] = vectors[0]
    ids = np.arange(900)
    got = answers(search(table(spark, ids, vectors), F.col("id") % 20 == 0, k=10, sample=600, parts=4, per_part=50))
    assert [j for j, _ in got[0]] == list(range(1, 11)) and [j for j, _ in got[20]] == list(range(10))
    assert all(d == 0 for _, d in got[40])
    assert mean_recall(got, ids, vectors, 10) >= 0.9


def test_few_rows_give_all_candidates(spark):
    vectors = [[1, 0], [0, 1], [1, 1]]
    got = answers(search(table(spark, [0, 1, 2], vectors), F.col("id") == 0, k=10))
    assert [j for j, _ in got[0]] == [2, 1] and got[0][0][1] == 1.0 and abs(got[0][1][1] - math.sqrt(2)) < 1e-12


def test_every_query_meets_k_others(spark):
    """Parts smaller than k are not enough, so further ones are opened."""
    rng = np.random.default_rng(5)
    vectors, ids = rng.normal(size=(120, 4)), np.arange(120)
    got = answers(search(table(spark, ids, vectors), F.col("id") % 20 == 0, k=30, sample=120, parts=12, per_part=5, target=0.1))
    assert all(len(rows) == 30 for rows in got.values()) and len(got) == 6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.5]), (8, [2.0, 0.0]), (9, [0.0, 1.0])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "id long, vector array<double>, part string")
    found = search(docs, F.col("id") % 4 == 0, k=10)
    got = sorted((r.query_id, r["rank"], r.id, round(r.distance, 6)) for r in found.collect())
    zero = [(0, 1, 0, 0.0), (0, 2, 8, 1.0), (0, 3, 9, 1.414214)]
    assert got == sorted(zero * 2 + [(8, 1, 0, 1.0), (8, 2, 0, 1.0), (8, 3, 9, 2.236068)])
    assert search(spark.createDataFrame([], SCHEMA), F.col("id") == 0).count() == 0
    assert search(docs.where("id = 1"), F.col("id") == 1).count() == 0
    huge = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [-1e200, 0.0])], "id long, vector array<double>")
    assert [(r.id, r.distance) for r in search(huge, F.col("id") == 0).orderBy("rank").collect()] == [(1, 1.0), (2, inf)]
