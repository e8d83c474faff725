import math
import random
import re
import zlib
from collections import Counter

import pytest

from tidewell.llm import ngram
from tidewell.llm.ngram import BUCKETS, PRIOR, ROUNDS, SETTLED, fold_of, score_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


def corpus():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(words[(k * k + rng.randrange(3)) % 40] for k in range(rng.randrange(1, 60)))) for i in range(300)]
    return rows + [(301, None), (302, ""), (303, "Only\x0bHERE é É"), (303, "w1 w2"), (None, "w3 w4"), (304, "w1 " * 2000)]


def contexts(words, k):
    """A token's last k - 1 tokens before it, shorter at the start, where one start stands."""
    return [(("<s>", *words[:i])[-(k - 1) :] if k > 1 else (), w) for i, w in enumerate(words)]


def model(texts, order):
    grams = [Counter(g for t in texts for g in contexts(t, k)) for k in range(1, order + 1)]
    seen = [Counter(c for t in texts for c, _ in contexts(t, k)) for k in range(1, order + 1)]
    return grams, seen


def bucket(n):
    return 0 if n == 0 else 1 + min(int(math.log2(n)), BUCKETS - 2)


def probabilities(grams, seen, weights, n_words, words, order):
    """(context buckets, estimates, mixed) by order for each token."""
    out = []
    by_order = [contexts(words, k) for k in range(1, order + 1)]
    for i in range(len(words)):
        p, rows = 1 / (n_words + 1), []
        for k in range(order):
            c, w = by_order[k][i]
            b = 1 if k == 0 else bucket(seen[k][c])
            f = grams[k][c, w] / seen[k][c] if seen[k][c] else 0.0
            below, share = p, weights[k][b]
            p = share * f + (1 - share) * below
            rows.append((b, f, below, p))
        out.append(rows)
    return out


def brute_weights(rest, deleted, order):
    grams, seen = model(rest, order)
    n_words = len(grams[0])
    weights = [[0.0] + [0.5] * (BUCKETS - 1) for _ in range(order)]
    for _ in range(ROUNDS):
        chosen, reached = [[0.0] * BUCKETS for _ in range(order)], [[0.0] * BUCKETS for _ in range(order)]
        for t in deleted:
            for rows in probabilities(grams, seen, weights, n_words, t, order):
                reach = 1.0
                for k in reversed(range(order)):
                    b, f, _, p = rows[k]
                    mine = reach * weights[k][b] * f / p
                    chosen[k][b] += mine
                    reached[k][b] += reach
                    reach -= mine
        new = []
        for k in range(order):
            overall = sum(chosen[k][1:]) / max(sum(reached[k][1:]), 1e-300)
            new.append([0.0] + [min((chosen[k][b] + PRIOR * overall) / (reached[k][b] + PRIOR), 1 - 1e-6) for b in range(1, BUCKETS)])
        moved = max(abs(x - y) for a, b in zip(new, weights) for x, y in zip(a, b))
        weights = new
        if moved < SETTLED:
            break
    return weights


def brute(rows, order):
    texts = [(fold_of(i), tokens(x)) for i, x in rows]
    weights = brute_weights([t for f, t in texts if f > 1], [t for f, t in texts if f == 1], order)
    grams, seen = model([t for f, t in texts if f != 0], order)
    return grams, seen, weights


@pytest.mark.parametrize(("block_tokens", "fanout", "order"), [(2_000_000, 4096, 3), (500, 4096, 2), (300, 3, 3)])
def test_scores_equal_brute_force(spark, monkeypatch, block_tokens, fanout, order):
    """Counts, base score and the mixture's score, in one block, many blocks and a tree of sums of several levels."""
    monkeypatch.setattr(ngram, "BLOCK_TOKENS", block_tokens)
    monkeypatch.setattr(ngram, "FANOUT", fanout)
    if fanout == 3:
        monkeypatch.setattr(ngram, "BLOCK_BYTES", 2000)  # some 20 blocks: groups of 7, 3 and 1
    rows = corpus()
    grams, seen, weights = brute(rows, order)
    train, n_words = {w: c for (_, w), c in grams[0].items()}, len(grams[0])
    n = sum(train.values())
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, block int").repartition(3)
    got = score_documents(docs, order).collect()
    want = []
    for i, x in rows:
        t = tokens(x)
        base = sum(math.log10((train.get(w, 0) + 0.1) / (n + 0.1 * (n_words + 1))) for w in t)
        score = sum(math.log10(p[-1][-1]) for p in probabilities(grams, seen, weights, n_words, t, order))
        want.append((i or 0, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(w in train for w in t), n, base, score))
    for g, w in zip(sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-4)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 1


def test_probabilities_sum_to_one(spark):
    """After every context, over all words of training, the end and one unseen word."""
    grams, seen, weights = brute(corpus(), 3)
    words = [w for _, w in grams[0]]
    for before in ([], ["w1"], ["w1", "w4"], ["neverseen", "w1"], ["w1", "neverseen"]):
        total = sum(probabilities(grams, seen, weights, len(words), [*before, w], 3)[-1][-1][-1] for w in [*words, "unseen"])
        assert total == pytest.approx(1, abs=1e-9)


def test_moved_rows_are_an_error(spark):
    table = lambda b: ngram.pa.table({"block": [2], "payload": [b]})
    b = {"vocabulary": ngram.np.array([5], "<u8"), "ids": ngram.np.array([0], "<u4"), "lengths": ngram.np.array([1], "<u4"), "held": ngram.np.array([False])}
    raw = ngram.np.array([1, 1, 1], ngram.np.int64).tobytes() + b["vocabulary"].tobytes() + ngram._planes(b["ids"]) + b["lengths"].tobytes() + b["held"].tobytes()
    with pytest.raises(RuntimeError, match="another order"):
        ngram._opened(table(ngram.zstandard.ZstdCompressor().compress(raw)), ngram.pa.table({"digest": [ngram.digest_of(b) ^ 1]}), 3)


def test_empty_table(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
