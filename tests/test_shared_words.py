"""Common words counted in cells against sets."""

import numpy as np
import pytest

from tidewell.operators import retrieval


@pytest.mark.parametrize("small", [False, True])
def test_best_lines_by_common_words(spark, monkeypatch, small):
    rng = np.random.default_rng(4)
    some = lambda n: sorted({f"w{i}" for i in rng.integers(0, 30, n)})
    asked = [(i, some(rng.integers(0, 12))) for i in range(40)]
    lines = [(f"line {i:03d}", i, some(rng.integers(0, 9))) for i in range(150)] + [("long", 900, [f"w{i}" for i in range(400)])]
    if small:
        monkeypatch.setattr(retrieval, "ASKED", 9)
        monkeypatch.setattr(retrieval, "COUNTED", 20)
        monkeypatch.setattr(retrieval, "ABREAST", 3)
    q, d = spark.createDataFrame(asked, "focus long, words array<string>"), spark.createDataFrame(lines, "line string, doc_id long, words array<string>")
    got: dict = {}
    found = retrieval.shared_words(q, d, "focus", "line", "words", 5).collect()
    for r in found:
        got.setdefault(r.focus, []).append((-r.shared, r.line, r.doc_id))
    for f, words in asked:
        want = sorted((-n, line, doc) for line, doc, k in lines if (n := len(set(k) & set(words))))[:5]
        assert sorted(got.get(f, []))[:5] == want
    assert len(found) <= 40 * 5 * (8 if small else 1)
