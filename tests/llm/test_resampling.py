import random

import numpy as np
import pytest

from tidewell.llm.resampling import BUCKETS, Buckets, features, resample
from tidewell.llm.sharding import row_boundary


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ta")) for _ in range(3))
    good = [(i, " ".join(word() for _ in range(rng.randrange(20, 80)))) for i in range(200)]
    bad = [(1000 + i, " ".join(word().upper() + "!!$" for _ in range(rng.randrange(20, 80)))) for i in range(50)]
    return good, bad


def test_weights_equal_brute_force_and_bad_text_goes(spark):
    good, bad = corpus()
    rows = [*good, *bad, (5000, None), (5001, ""), (good[0][0], good[0][1])]
    labels = [(i, 1) for i, _ in good[:120]] + [(i, 0) for i, _ in bad[:30]] + [(None, 1), (7, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, size double").repartition(3)
    got = resample(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    raw, target, chosen = np.zeros(BUCKETS), np.zeros(BUCKETS), {i for i, q in labels if q and i is not None}
    for i, t in rows:
        n = np.bincount(features(t or "", Buckets()), minlength=BUCKETS)
        raw += n
        target += n if i in chosen else 0
    ratio = np.log(target + 1) - np.log(target.sum() + BUCKETS) - np.log(raw + 1) + np.log(raw.sum() + BUCKETS)
    want = sorted((i, round(float(ratio[features(t or "", Buckets())].sum()), 6)) for i, t in rows)
    assert sorted((r.doc_id, round(r.log_weight, 6)) for r in got) == want
    kept = [r for r in got if r.kept]
    assert min(r.sample_key for r in kept) >= max(r.sample_key for r in got if not r.kept)
    assert not [r for r in kept if 1000 <= r.doc_id < 2000 and r.log_weight > 0]
    assert sum(not r.kept for r in got if r.doc_id < 1000) <= 2
    few = resample(docs, spark.createDataFrame(labels, "doc_id long, quality int"), k=17).collect()
    assert sum(r.kept for r in few) == 17


@pytest.mark.parametrize("rows", [0, 1, 57, 99, 100])
def test_boundary_has_exactly_so_many_rows_below(spark, rows):
    rng = np.random.default_rng(1)
    keys = spark.createDataFrame([(int(h), int(x), 1) for h, x in zip(rng.integers(-3, 3, 100), rng.integers(-(2**62), 2**62, 100))], "high long, low long, size long")
    edge = row_boundary(keys, rows)
    below = sum(((r.high + 2**63) << 64 | (r.low + 2**63)) < edge for r in keys.collect())
    assert below == rows


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = resample(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), none, k=1).collect()
    assert [r.log_weight for r in got] == [0, 0] and sum(r.kept for r in got) == 1
    assert resample(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
