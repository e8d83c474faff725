"""Products in single precision only choose which pairs are scored: the choice is small and never loses a pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_scored_pairs import score
from tidewell.operators import retrieval


def units(rng, n, d=64):
    v = rng.normal(size=(n, d)).astype(np.float32).astype(float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("keep", [1, 5, 40])
def test_few_pairs_are_scored_and_all_best_are_among_them(keep):
    rng = np.random.default_rng(8)
    x, y = units(rng, 30), units(rng, 4000)
    y[100:160] = y[99] + rng.normal(size=(60, 64)) * 1e-7  # nearly equal: single precision can't order them
    x[3], y[7], y[9] = y[99], 0.0, math.nan
    bounds = np.array([0, 20, 1500, 4000])
    at = retrieval._may_be_best(x.astype(np.float32), y.astype(np.float32), bounds, keep, 6)
    assert len(at) < 30 * (3 * (2 * keep + 20) + 70)
    code, chosen = retrieval._rounded(x, y, 6), set(at.tolist())
    for i in range(len(x)):
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            best = lo + np.argsort(-code[i, lo:hi], kind="stable")[:keep]
            assert chosen >= {int(i * len(y) + j) for j in best}


def test_of_equal_rows_only_so_many_stay_as_may_be_kept():
    y, stretch = np.zeros((900, 2)), np.repeat([0, 1, 2], 300)
    y[::2, 0] = 1.0
    few = retrieval._few_copies(y, stretch, 4)
    assert few.tolist() == [s * 300 + n for s in range(3) for n in range(8)]


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(9)
    vectors = [[float(np.float32(x)) for x in rng.normal(size=3)] for _ in range(60)] + [None, [0.0] * 3, [1.0], [1.0, None, 2.0], [math.nan, 1.0, 1.0]]
    vectors += [[1.0, 0.0, 0.0], [0.5, 0.75**0.5, 0.0], [0.5 + 4e-7, 0.75**0.5, 0.0], [0.5 - 6e-7, 0.75**0.5, 0.0]]  # at the floor and about it
    rows = [(i, v, 10.0 + i, 20.0 + i, 30.0 + i, 40.0 + i) for i, v in enumerate(vectors)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<double>, low double, high double, none double, nan double")


def test_a_floor_without_scores(odd):
    rows, df = odd
    found = retrieval.score_pairs(df, df.select("id", "embedding"), "id", "id", floor=0.5, score=False)
    assert found.columns == ["id", "query"]
    want = [(q[0], r[0]) for q in rows for r in rows if (s := score(q[1], r[1])) is None or not s < 0.5]
    assert sorted((r["query"], r["id"]) for r in found.collect()) == sorted(want)


def test_a_column_by_the_stretch_of_the_score(odd):
    rows, df = odd
    found = retrieval.score_pairs(df, df, "id", "id", levels=((0.5,), ("low", "high", "none", "nan")))
    assert found.columns == ["id", "query", "value"]
    column = lambda s: 4 if s is None else 5 if math.isnan(s) else 2 if s < 0.5 else 3
    want = [(q[0], r[0], r[column(score(q[1], r[1]))]) for q in rows for r in rows]
    assert sorted((r["query"], r["id"], r["value"]) for r in found.collect()) == sorted(want)


def test_floats_cross_to_the_cells_as_floats(spark):
    df = spark.range(40).select("id", F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).cast("array<float>").alias("embedding"))
    found = retrieval.score_pairs(df, df, "id", "id", keep=3, apart=True)
    assert "array<double>" not in found._jdf.queryExecution().analyzed().toString() and found.count() == 120
