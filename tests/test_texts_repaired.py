"""Cut JSON, glued words and outlines against brute force."""

import itertools
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.functions.partial_json import complete, completed, partial_field
from tidewell.operators import segmentation
from tidewell.operators.outline import heading_tree, match_paragraphs, sections_of
from tidewell.operators.segmentation import cheapest, split_glued

WHOLE = {"title": 'A "quoted" \\ name\n', "n": -12.5e3, "ok": True, "none": None, "list": [1, [2, {"deep": "ü😀"}], "x", []], "empty": {}, "last": "end"}


def holds(part, whole):
    """Whether what was saved says nothing that the whole doesn't."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and holds(v, whole[k]) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and len(part) <= len(whole) and all(map(holds, part, whole))
    if isinstance(part, str):
        return isinstance(whole, str) and whole.startswith(part)
    return part == whole and type(part) is type(whole)


@pytest.mark.parametrize("ascii_,indent", [(True, None), (False, 2)])
def test_every_prefix_has_an_answer(ascii_, indent):
    raw = "Here: ```json\n" + json.dumps(WHOLE, ensure_ascii=ascii_, indent=indent)
    seen = -1
    for n in range(len(raw) + 1):
        body, status = complete(raw[:n])
        assert status == ("missing" if "{" not in raw[:n] else "complete" if n == len(raw) else "partial")
        if body is not None:
            part = json.loads(body)
            assert holds(part, WHOLE), (raw[:n], body)
            assert len(part) >= seen
            seen = len(part)
    assert json.loads(complete(raw + " tail {")[0]) == WHOLE


def test_broken_objects():
    assert complete('{"a": 1, "b": [1, 2,], }') == ('{"a":1,"b":[1,2]}', "complete")
    assert complete('{"a": "x", oops "b": 2}') == ('{"a":"x"}', "partial")
    assert complete('{"a": {"b": "c') == ('{"a":{"b":"c"}}', "partial")
    assert complete('{"a": 12') == ("{}", "partial") and complete('{"a": tru') == ("{}", "partial")
    assert complete("{]") == ("{}", "partial") and complete(None) == (None, "missing") and complete("") == (None, "missing")
    assert complete('{"a":}') == ("{}", "partial") and complete('{"a" "b"}') == ("{}", "partial")


def test_columns(spark):
    raw = json.dumps({"id": 1, "note": 'say "hi"\nü'})
    rows = [(n, raw[:n]) for n in range(len(raw) + 1)] + [(-1, None)]
    frame = spark.createDataFrame(rows, "n int, raw string")
    for r in frame.select("n", "raw", completed("raw").alias("c"), partial_field("raw", "NOTE").alias("f")).collect():
        assert (r.c.body, r.c.status) == complete(r.raw)
        opened = raw.index('"note": "') + 9
        if r.n < opened:
            assert (r.f.value, r.f.status) == ("", "missing")
        else:
            assert r.f.status == ("complete" if r.n >= len(raw) - 1 else "partial")
            assert 'say "hi"\nü'.startswith(r.f.value) and (r.f.status == "partial" or r.f.value == 'say "hi"\nü')


def test_cheapest_way_equals_all_cuts():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 9)
        cost = {(a, b): rng.randrange(1, 40) / 4 for a in range(n) for b in range(a + 1, n + 1) if rng.random() < 0.5}
        def price(cuts):
            ends = [0, *cuts, n]
            return sum(min(cost.get((a, b), math.inf), 12.0 if b == a + 1 else math.inf) for a, b in zip(ends, ends[1:]))
        best = min(price(c) for k in range(n) for c in itertools.combinations(range(1, n), k))
        assert abs(price(cheapest(n, [(a, b, c) for (a, b), c in cost.items()], 12.0)) - best) < 1e-9


def test_glued_words(spark):
    plain = "the retrieval of augmented generation models makes vector search systems faster"
    rows = [(1, plain), (2, plain + " indeed"), (3, "TheRetrievalOfAugmentedGeneration is vectorsearchsystems."), (4, "code `theretrievalofaugmentedgeneration` and $theretrievalofaugmentedgeneration$ stay"),
            (5, "qqqqqqqqqqqqqqqqqqqqqqqq"), (6, None), (7, ""), (8, "see https://x.org/theretrievalofaugmentedgeneration and theretrievalofaugmentedgeneration1"), (9, "z" * 500)]
    texts = spark.createDataFrame([(*r, "clash") for r in rows], "id int, body string, word string")
    got = {r.id: r.body for r in split_glued(texts, "id", "body", least=19).collect()}
    want = dict(rows) | {3: "The Retrieval Of Augmented Generation is vector search systems."}
    assert got == want


def test_glued_words_whose_parts_are_rare(spark, monkeypatch):
    """Words beyond the broadcast ones are found through the filter; all ways give the same splits."""
    rng = random.Random(8)
    vocabulary = sorted({"".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(120)})
    rows = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(60)] + [(100 + i, "".join(rng.choices(vocabulary, k=6)).title()) for i in range(40)]
    texts = spark.createDataFrame(rows, "id int, body string")
    counts = Counter(w for _, t in rows[:60] for w in t.split())
    total, want = sum(counts.values()), dict(rows)
    for i, w in rows[60:]:
        if len(w) >= 20:
            spans = [(a, b, math.log(total / counts[w[a:b].lower()])) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if w[a:b].lower() in counts]
            cuts = cheapest(len(w), spans, math.log(total) + segmentation.UNKNOWN)
            want[i] = " ".join(w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)]))
    for frequent, share in ((100_000, 500), (20, 3)):
        monkeypatch.setattr(segmentation, "FREQUENT", frequent)
        monkeypatch.setattr(segmentation, "SHARE", share)
        table = spark.createDataFrame(list(counts.items()), "word string, n long")
        assert {r.id: r.body for r in split_glued(texts, "id", "body", table).collect()} == want
        found = segmentation.splits(spark.createDataFrame([(w,) for _, w in rows[60:]], "word string"), table)
        assert found.rdd.getNumPartitions() >= 40 // share  # much work on few bytes goes to many tasks


def test_outline(spark):
    rng = random.Random(5)
    heads = [(d, i, rng.randrange(1, 7), f"T{rng.randrange(6)}") for d in range(4) for i in range(30)]
    frame = spark.createDataFrame(heads, "doc int, i int, level int, title string")
    got = {(r.doc, r.i): (r.parent, r.path) for r in heading_tree(frame, ["doc"], "i", "level", "title").collect()}
    for d in range(4):
        stack = []
        for _, i, level, title in [h for h in heads if h[0] == d]:
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert got[d, i] == (stack[-1][0] if stack else None, [t for _, _, t in stack] + [title])
            stack.append((i, level, title))
    paragraphs = spark.createDataFrame([(d, p, f"{p}. t{(p * 7 + d) % 9}  " if p % 3 else "body text") for d in range(4) for p in range(60)], "doc int, p int, text string")
    matched = match_paragraphs(frame, paragraphs, ["doc"], "i", "title", "p", "text").collect()
    bears = {}
    for d in range(4):
        for p in range(60):
            if p % 3:
                bears.setdefault((d, f"t{(p * 7 + d) % 9}"), []).append(p)
    seen = {}
    for r in sorted(matched, key=lambda r: (r.doc, r.i)):
        k = seen[r.doc, r.title] = seen.get((r.doc, r.title), -1) + 1
        of = bears.get((r.doc, r.title.lower()), [])
        assert r.start == (of[k] if k < len(of) else None)
    starts = spark.createDataFrame([(1, 3, "A"), (1, 10, "B"), (2, None, "C")], "doc int, start int, title string")
    places = spark.createDataFrame([(1, 2), (1, 3), (1, 9), (1, 10), (1, 99), (2, 5)], "doc int, first int")
    assert sorted((r.doc, r["first"], r.section) for r in sections_of(places, starts, ["doc"], "first", "start", "title").collect()) == [(1, 2, None), (1, 3, "A"), (1, 9, "A"), (1, 10, "B"), (1, 99, "B"), (2, 5, None)]
