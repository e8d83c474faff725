import re

from tidewell.llm.quality import BASE_RULES, RULES, Rule, Text, judge, keep_documents, order_rules, sampled_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = " ".join(f"word{i} tale" for i in range(40))
ROWS = [
    (1, None), (2, ""), (3, CLEAN), (4, CLEAN + "\n" + CLEAN), (5, "a b c d " * 30), (6, CLEAN.replace(" ", "$$ ")), (7, CLEAN.upper()),
    (8, CLEAN.replace(" ", "!! ")), (9, "naïve café 你好  x y " * 3), (9, "one\n\none\n two \none"), (None, CLEAN), (10, CLEAN * 300),
]


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 3000 else None
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit) if hit is not None else None


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in ROWS], "doc_id long, text string, kept boolean")
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines): r for r in judge(docs).collect()}
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        n, chars, symbols, dup, repeat = brute(t)
        r = got[i, n, chars, symbols, dup]
        assert repeat is None or r.n_repeat_words == repeat
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n)
        assert r.kept == (not r.base_failed and not any(x.rejects(Text((t or "").encode())) for x in RULES))
    assert {r.doc_id for r in got.values() if r.kept} == {3, None}


def test_keep_documents_keeps_all_columns(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in ROWS], "doc_id long, text string, words string")
    assert sorted((r.doc_id or 0, r.words) for r in keep_documents(docs).collect()) == [(0, "k"), (3, "k")]


def test_order_does_not_change_the_verdict():
    texts = [t or "" for _, t in ROWS]
    assert {r.name for r, _, _ in order_rules(texts)} == {r.name for r in RULES}
    ranked = [s / c for _, c, s in order_rules(texts)]
    assert ranked == sorted(ranked, reverse=True)


def test_the_order_saves_evaluations(monkeypatch):
    """A cheap rule that rejects much runs first, and what it rejects is neither counted nor seen by the others."""
    from tidewell.llm import quality

    seen, counted = [], []
    real = quality.repeated_words
    monkeypatch.setattr(quality, "repeated_words", lambda w: counted.append(1) or real(w))
    named = lambda r: Rule(r.name, lambda t: seen.append(r.name) or r.rejects(t))
    rules = tuple(map(named, (*reversed(RULES), *reversed(BASE_RULES))))
    texts = [CLEAN] * 20 + ["a few words"] * 80
    verdicts = lambda ordered: [any(r.rejects(t) for r in ordered) for t in map(Text, (x.encode() for x in texts))]
    ordered = [r for r, _, _ in order_rules(texts, rules)]
    seen.clear(), counted.clear()
    plain = verdicts(rules)
    n_plain, c_plain = len(seen), len(counted)
    seen.clear(), counted.clear()
    assert verdicts(ordered) == plain
    assert ordered[0].name == "few_words" and len(seen) < n_plain / 2 and len(counted) == 20 < c_plain


def test_sample_is_spread_and_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 7 = 0, repeat('x', 100000), concat('t', id)) AS text").repartition(8, "doc_id")
    got = sampled_texts(docs, "text", 100)
    assert len(got) == 100 and max(map(len, got)) < 10
    assert max(int(t[1:]) for t in got) - min(int(t[1:]) for t in got) > 2000


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
