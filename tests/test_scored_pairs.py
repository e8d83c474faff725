"""Pairs scored in cells against one product for each pair, on odd vectors and small cells."""

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import retrieval


def score(a, b):
    """As the column expressions have it: null without vector or for other lengths, no number for no number."""
    if a is None or b is None or len(a) != len(b):
        return None
    units = []
    for v in (a, b):
        n = math.nan if None in v else math.sqrt(sum(x * x for x in v))
        units.append([0.0] * len(v) if None in v or n == 0 else [x / n for x in v])
    s = 0.0
    for x, y in zip(*units):
        s += x * y
    return s if math.isnan(s) else float(Decimal(repr(s)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def order(x):
    return (x[0] is None, 0 if x[0] is None else -math.inf if math.isnan(x[0]) else -x[0], x[1])


@pytest.mark.parametrize("small", [False, True])
def test_best_of_each_query_and_kind(spark, monkeypatch, small):
    rng = np.random.default_rng(3)
    vectors = [[float(np.float32(x)) for x in rng.normal(size=4)] for _ in range(80)] + [None, [0.0] * 4, [1.0], [1.0, None, 2.0, 3.0], [math.nan, 1.0, 1.0, 1.0]]
    vectors += [vectors[7]] * 30  # copies, whose ties go by id
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    if small:
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 500)
        monkeypatch.setattr(retrieval, "CELL", 16)
        monkeypatch.setattr(retrieval, "TILE", 40)
    df = spark.createDataFrame(rows, "id long, embedding array<double>, kind int")
    got: dict = {}
    found = retrieval.score_pairs(df.where("id % 5 = 0"), df, "id", "id", keep=4, within=["kind"], apart=True)
    for r in found.collect():
        got.setdefault((r["query"], r["kind"]), []).append((r["score"], r["id"]))
    for q, v, _ in rows[::5]:
        for kind in range(3):
            want = sorted(((score(v, w), i) for i, w, k in rows if k == kind and i != q), key=order)[:4]
            assert repr(sorted(got[q, kind], key=order)[:4]) == repr(want), (q, kind)
    every = retrieval.score_pairs(df.where("id % 5 = 0"), df.select("id", "embedding"), "id", "id", floor=0.5).collect()
    want = [(q, i) for q, v, _ in rows[::5] for i, w, _ in rows if (s := score(v, w)) is None or not s < 0.5]
    assert sorted((r["query"], r["id"]) for r in every) == sorted(want)


def test_a_half_rounds_as_the_sum_in_order_does():
    a, b = np.array([[0.5, 1.0, -0.5, -1e-9]]), np.array([[0.000001, 0, 0, 0], [0, 0, 0.000001, 0], [0.000003, 0, 0, 1.0], [0, 0.25, 0, 0]])
    assert retrieval._rounded(a, b, 6).tolist() == [[1, -1, 1, 250000]]


def test_what_leaves_a_cell_is_bounded(spark):
    df = spark.range(3000).select("id", F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("embedding"))
    cells = math.ceil(3000 / 1024)
    assert retrieval.score_pairs(df.where("id % 50 = 0"), df, "id", "id", keep=5).count() == 60 * cells * 5
