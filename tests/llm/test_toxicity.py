import random

import numpy as np

from tidewell.llm.toxicity import drop_toxic, learn, remainder, segments, solve_lambda, toxic_scores
from pyspark.sql import functions as F


def brute_segments(s, lo=0):
    """The best segment, then those left and right of it; of equal ones the shortest."""
    best = None
    for i in range(len(s)):
        for j in range(i, len(s)):
            total = sum(s[i : j + 1])
            if total > 1e-12 and (best is None or total > best[2] + 1e-12 or (abs(total - best[2]) <= 1e-12 and j - i < best[1] - best[0])):
                best = (i, j, total)
    if best is None:
        return []
    i, j, total = best
    return brute_segments(s[:i], lo) + [(lo + i, lo + j, total)] + brute_segments(s[j + 1 :], lo + j + 1)


def test_segments_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        s = rng.normal(-0.3, 1, int(rng.integers(0, 25)))
        got = segments(s)
        want = brute_segments(s.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_lambda_solves_the_equation():
    s = np.random.default_rng(2).normal(-0.5, 1, 5000)
    assert abs(np.exp(solve_lambda(s) * s).mean() - 1) < 1e-6


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ta", "re")) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randrange(20, 200))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), "vile" + rng.choice(("", "ka", "lo", "mi")))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    rows += [(2000, None), (2001, ""), (None, "ka lo"), (2002, "Vile! " * 40)]
    docs = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, score double").repartition(3)
    marks = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    held = remainder(F.col("_label_id"), 5) == 0
    scored = toxic_scores(docs, learn(docs, marks, held)).collect()
    got = {r.doc_id: r for r in scored}
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    truth = dict(labels)
    import zlib

    test = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i].score >= 0.5) == truth[i] for i in test]) > 0.95
    assert got[2002].score > 0.9 and got[2000].score == got[2001].score < 0.5
    assert got[2002].passages[0].first == 0 and not got[2000].passages


def test_drop_toxic_keeps_columns_and_clean_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = {r.doc_id for r in drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("source = 's'").collect()}
    truth = dict(labels)
    assert np.mean([i not in kept for i in truth if truth[i]]) > 0.9
    assert np.mean([i in kept for i in truth if not truth[i]]) > 0.97


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxic_scores(docs, learn(docs, none, F.lit(False))).collect()] == [0.0]
    assert toxic_scores(docs.limit(0), learn(docs, none, F.lit(False))).count() == 0
