"""Source divergence against dense counting in plain Python, and the sketch's promise."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm.divergence import audit, document_frequencies, places, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, TERM.findall(text.translate(LOWER))) for lang, source, text in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in found:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=lambda t: t.encode())
        sources = sorted({r[1] for r in rows if r[0] == lang}, key=lambda t: t.encode())

        def p(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + (10**9 * (of[t] + 2)) // (n + 2 * len(kept)) for t in kept}

        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        each = {s: p(counts[lang, s]) for s in sources}

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in sources:
            values = sorted(((-sum(f(each[s][t], each[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(values)]
            marks = sorted((-f(each[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and each[s][t] > whole[t])
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(marks[:top])]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(3)
    words = ["the", "The", "over", "É", "été", "naïve", "x1y", "don't", "語", "tail", *[f"w{chr(97 + k)}" for k in range(26)]]
    rows = []
    for k in range(240):
        lang = ["en", "de", None, "empty"][k % 4]
        source = ["hot", "hot", f"s{k % 7}", None][k % 4 if k % 3 else 2]
        text = None if lang == "empty" else " ".join(words[int(i)] for i in rng.zipf(1.4, 30) % len(words)) + (" only" + source if source == "s1" else "")
        rows.append((lang, source, text))
    return rows + [("en", "none", ""), ("en", "digits", "1 2 3 !"), ("lone", "one", "word " * 40)] + [("en", "hot", "the the repeated")] * 12


@pytest.mark.parametrize("width", [1 << 12, 64])
def test_equals_dense_counting(spark, width):
    """A sketch too small to rule anything out gives the same rows."""
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term int, n int").repartition(5)
    got = sorted(tuple(r) for r in audit(docs, least_docs=10, top_terms=4, width=width).collect())
    assert got == plainly(rows, 10, 4)


def test_ties_and_one_document_bounds(spark):
    rows = [("en", "a", "x y z"), ("en", "b", "z y x"), ("en", "c", "x y z q")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in audit(docs, least_docs=1, top_terms=2, width=256).collect()) == plainly(rows, 1, 2)
    with pytest.raises(ValueError, match="bound"):
        audit(docs, least_docs=300)


def test_the_sketch_never_underestimates(spark):
    rows = [("en" if k % 2 else "fr", f"word{k % 50} word{k % 50} other{k % 500} all") for k in range(2000)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    for width in (64, 1 << 14):
        sketch = document_frequencies(docs, width)
        assert sketch.shape == (3, width)
        for lang in ("en", "fr"):
            true = Counter(t for x, text in rows if x == lang for t in set(terms_of(text)))
            at = places(lang, list(true), width)
            least = np.min([sketch[k][at[k]] for k in range(3)], axis=0)
            assert (least >= np.minimum(255, np.fromiter(true.values(), int))).all()
            if width > 1000:
                assert (least == np.minimum(255, np.fromiter(true.values(), int))).mean() > 0.95


def test_terms_that_cannot_reach_the_bound_do_not_leave_the_scan(spark):
    from tidewell.llm.divergence import count_terms

    rows = [("en", "s", f"common rare{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    got = count_terms(docs, document_frequencies(docs, 1 << 14), 10).collect()
    assert {r.term for r in got} == {"common"} and sum(r.n for r in got) == sum(r.docs for r in got) == 300
    assert all([tuple(x) for x in r.found] == [("s", r.n)] for r in got)


def test_hashes_do_not_depend_on_how_a_text_is_cut(monkeypatch):
    from tidewell.llm import divergence

    words = ["a", "b" * 63, "c" * 64, "d" * 65, "e" * 1000, "été", "f" * 129, "x"] * 3
    raw = " ".join(words).encode() + b"  tail " + b"g" * 700
    starts, whole = divergence.word_hashes(raw)
    assert [raw[k:].split()[0] for k in starts.tolist()] == raw.split() and len(set(whole.tolist())) == 10
    monkeypatch.setattr(divergence, "PIECE", 128)
    again, cut = divergence.word_hashes(raw)
    assert (cut == whole).all() and (again == starts).all()
    hashes, n = divergence.holders(["the cat the", "", "The end", "cat 1 cat"])
    assert sorted(n.tolist()) == [1, 2, 2] and len(set(hashes.tolist())) == 3


def test_odd_tables(spark):
    schema = "lang string, source string, text string"
    assert audit(spark.createDataFrame([], schema)).count() == 0
    long = spark.createDataFrame([("en", "a", "word " * 400_000), ("en", "b", "x" * 2_000_000), ("en", "b", None)], schema)
    got = sorted(tuple(r) for r in audit(long, least_docs=1, top_terms=1).collect())
    assert [(r[1], r[2], r[5]) for r in got] == [("a", "pair", 1), ("a", "term", 1), ("b", "pair", 1), ("b", "term", 1)]
    assert audit(long.withColumn("doc_id", F.lit(None).cast("long"))).count() == 2
