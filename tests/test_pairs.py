"""Pairs, clusters and streams of near vectors against brute force, with blocks smaller than groups."""

import numpy as np
import pytest

from tidewell.operators import dedup, greedy, matching, retrieval


def vectors(rng, n, d=6, groups=3):
    base = rng.normal(size=(n // 4 + 1, d))
    v = [base[rng.integers(len(base))] + rng.normal(size=d) * rng.choice([0, 0.05, 0.5]) for _ in range(n)]
    rows = [(int(i), int(rng.choice(groups, p=[0.7, 0.2, 0.1])), x.tolist()) for i, x in enumerate(v)]
    return rows + [(n, 0, [0.0] * d), (n + 1, 0, [0.0] * d), (n + 2, 1, None)]


def cosines(rows):
    m = np.array([r[2] or [0.0] * 6 for r in rows])
    u = m / np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), 1)[:, None]
    return np.round(u @ u.T, 9)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g int, v array<double>").repartition(3)


@pytest.mark.parametrize(("block", "threshold", "within"), [(2048, 0.8, ["g"]), (16, 0.95, ["g"]), (16, 0.5, None), (16, -0.2, ["g"])])
def test_pairs_equal_brute_force(spark, monkeypatch, block, threshold, within):
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "PIVOTS", 7)
    rows = vectors(np.random.default_rng(4), 160)
    c = cosines(rows)
    want = {(a[0], b[0], c[i, j]) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a[2] and b[2] and c[i, j] >= threshold and (not within or a[1] == b[1])}
    got = [tuple(r) for r in dedup.similar_pairs(frame(spark, rows), "id", "v", threshold, within).collect()]
    assert len(got) == len(set(got)) and {g[:2] for g in got} == {w[:2] for w in want}
    links = dedup.similar_pairs(frame(spark, rows), "id", "v", threshold, within, forest=True)
    nodes = spark.createDataFrame([(r[0],) for r in rows], "node long")
    assert sorted(dedup.components(nodes, links).collect()) == sorted(dedup.components(nodes, spark.createDataFrame([w[:2] for w in want], "a long, b long")).collect())


@pytest.mark.parametrize(("block", "threshold"), [(2048, 0.9), (16, 0.6)])
def test_accepted_rows_equal_one_pass_in_order(spark, monkeypatch, block, threshold):
    monkeypatch.setattr(dedup, "BLOCK", block)
    rows = vectors(np.random.default_rng(5), 140)
    rows += [(1000 + i, 0, rows[3][2]) for i in range(40)]  # a large group of copies
    c, kept = cosines(rows), {}
    for i, r in enumerate(rows):
        if all(c[i, j] <= threshold for j in kept.get(r[1], [])):
            kept.setdefault(r[1], []).append(i)
    got = greedy.accept_stream(frame(spark, rows), ["g"], "id", "v", threshold)
    assert sorted(r.id for r in got.collect()) == sorted(rows[i][0] for k in kept.values() for i in k)


def test_queries_are_broadcast_in_blocks(spark, monkeypatch):
    rows = frame(spark, [r for r in vectors(np.random.default_rng(6), 60) if r[2]])
    whole = sorted(map(tuple, retrieval.nearest(rows.where("id % 5 = 0"), rows, "id", "id", 3, vector="v", apart=True).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 300)
    assert sorted(map(tuple, retrieval.nearest(rows.where("id % 5 = 0"), rows, "id", "id", 3, vector="v", apart=True).collect())) == whole
    assert len(whole) == 39 and all(r[0] != r[1] for r in whole)


def test_containment_of_whole_texts_within_keys(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("ab"), rng.integers(1, 4)))
    left = [(int(rng.integers(3)), i, " ".join(word() for _ in range(rng.integers(0, 5)))) for i in range(60)] + [(0, 99, None), (0, 98, "long common beginning one")]
    right = [(int(rng.integers(3)), i, " ".join(word() for _ in range(rng.integers(0, 9)))) for i in range(60)] + [(0, 97, "a long common beginning one and two"), (1, 96, "a long common beginning one")]
    a, b = spark.createDataFrame(left, "g int, i int, a string"), spark.createDataFrame(right, "g int, j int, b string")
    got = sorted((r.g, r.i, r.j) for r in matching.containment(a, b, "a", "b", keys=["g"]).collect())
    blank = lambda t: not (t or "").strip()
    assert got == sorted((g, i, j) for g, i, x in left for h, j, y in right if g == h and not blank(x) and not blank(y) and (x in y or y in x))
    assert (0, 98, 97) in got


def test_vectors_move_by_blocks_and_not_by_cells(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 64)
    rows = [r for r in vectors(np.random.default_rng(9), 160) if r[2] and any(r[2])]
    placed, met = dedup._cells(frame(spark, rows).selectExpr("id AS _key", "v AS _v"), [], -1.0)
    assert placed.count() == len(rows) and met.count() <= 6  # 160 vectors are three blocks, however many cells they lie in
