import random
import re

import numpy as np

import pytest

from tidewell.llm.jaccard import documents_of, keep_one_per_group, link_components, pick_prefix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute(rows, percent=90):
    ids = sorted({i for i, _ in rows})
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, shingle_set(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            same = len(a & b)
            if same and 100 * same >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return sorted((i, len(s), top(i)) for i, s in sets)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, token string").repartition(parts)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in link_components(documents_of(docs)).collect())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one\x0btwo"), (907, "é É"), (908, "É É")]
    base = [f"w{rng.randrange(60)}" for _ in range(90)]
    rows += [(i, edited(rng, base, rng.randrange(0, 4))) for i in range(120)]  # a hot group around the threshold
    for g in range(12):
        words = [f"v{rng.randrange(4000)}" for _ in range(rng.randrange(20, 200))]
        rows += [(200 + 10 * g + k, edited(rng, words, rng.randrange(0, 5))) for k in range(6)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(400 + k, passage + " " + " ".join(f"z{rng.randrange(9999)}" for _ in range(80))) for k in range(60)]
    rows += [(500 + k, " ".join(base)) for k in range(20)]
    assert found(spark, rows) == brute(rows)


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(2)
    counters = rng.integers(1, 50, 1 << 8).astype(np.int32)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 40, int(rng.integers(1, 80))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.04], rng.integers(0, 1 << 40, 2).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if 100 * same >= 90 * len(np.union1d(a, b)):
            (la, pa), (lb, pb) = (pick_prefix(x, counters, 5.0, 20.0, 90) for x in (a, b))
            assert len(np.intersect1d(pa, pb)) >= min(la, lb)


def test_keeps_one_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(1, text, "a"), (2, text + " x", "b"), (3, text.upper(), "c"), (4, None, "d"), (5, "", "e"), (None, text, "f")], "doc_id long, text string, node string")
    assert sorted((r.doc_id or 0, r.node) for r in keep_one_per_group(docs).collect()) == [(0, "f"), (1, "a"), (4, "d"), (5, "e")]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_small_cells_and_size_classes(spark, monkeypatch):
    """Hot shingles in several cells, sets of many sizes: the same components as all pairs give."""
    import numpy as np

    from tidewell.llm import jaccard

    monkeypatch.setattr(jaccard, "CELL", 8)
    monkeypatch.setattr(jaccard, "FEW", 4)
    rng = np.random.default_rng(11)
    rows = []
    for k in range(160):
        n = int(rng.integers(6, 60))
        base = [f"b{k % 8}w{j}" for j in range(n)]
        if k % 3:
            base[int(rng.integers(0, n))] = f"edit{k}"
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for _, t in rows]
    for percent in (50, 80):
        label = list(range(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same) and label[a] != label[b]:
                    label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
        got = {r.doc_id: r.component_id for r in jaccard.link_components(docs, 3, percent, star_rounds=0).collect()}
        assert got == {r[0]: label[k] for k, r in enumerate(rows)}


def test_without_pairs_no_text_is_read_again(spark, monkeypatch):
    from tidewell.llm import jaccard

    monkeypatch.setattr(jaccard, "candidate_sets", lambda *a: pytest.fail("texts are read though there is no pair"))
    docs = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k}") for k in range(40)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.link_components(docs).collect()} == {(k, k) for k in range(40)}
