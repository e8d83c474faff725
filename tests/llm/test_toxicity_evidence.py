"""The fit uses all segments and all scores of the set-aside documents."""

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import toxicity
from tidewell.llm.toxicity import WordScores, features, labelled, learn, segments, solve_lambda, tokens_of


def test_weights_equal_repeated_scores():
    s, n = np.array([-1.0, -0.25, 0.5, 2.0]), np.array([700, 90, 40, 3])
    assert abs(solve_lambda(s, n) - solve_lambda(np.repeat(s, n))) < 1e-9
    assert abs((np.exp(solve_lambda(s, n * 10**7) * s) * n).sum() / n.sum() - 1) < 1e-6


def test_curve_is_fitted_on_all_segments(spark, monkeypatch):
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    aside = {r._label_id for r in labelled(marks, F.lit(False), 1000, "doc_id", "toxic").where("_aside").collect()}
    toxic = lambda i: ("vile " + "calm " * 9) * 150 if i in aside else "vile " * 20
    rows = [(i, toxic(i) if i % 3 == 0 else "calm " * 300 + "ka lo mi " * (i % 7), int(i % 3 == 0)) for i in range(120)]
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), []
    fit = toxicity.fit_curve
    monkeypatch.setattr(toxicity, "fit_curve", lambda x, y: seen.append((x, y)) or fit(x, y))
    model = learn(docs.select("doc_id", "text"), marks, F.lit(False))
    want, most = [], 0
    for i, text, label in rows:
        if i in aside:
            (s,) = WordScores(model).of([tokens_of(text)])
            most = max(most, len(segments(s)))
            want.append((label, *features(model, segments(s), len(s))))
    got = [(y, *x) for x, y in zip(*seen[0])]
    assert most > 64 and np.allclose(sorted(got), sorted(want))
