"""The score from counts to probability, written out in plain Python, and the pipeline's toxicity and packing held against it."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import toxicity
from tidewell.llm.toxicity import SHIFT, STRENGTH, TABLE, labelled, learn, remainder, slots, tokens_of, toxic_scores

DATA = "/root/testdata/sf0.01"


def positive_runs(scores):
    """All maximal segments by their definition: the best segment, then the same left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j)
    if at is None:
        return []
    return positive_runs(scores[: at[0]]) + [best] + positive_runs(scores[at[1] + 1 :])


class Plain:
    """Counts, law and curve of labelled texts."""

    def __init__(self, texts, aside):
        self.counts = np.zeros((2, 3 * TABLE))
        for text, label in texts:
            for at in slots(tokens_of(text)):
                for k in at:
                    self.counts[label, k] += 1
        total = self.counts[:, :TABLE].sum(axis=1)
        self.base = (total[1] + 1) / (total.sum() + 2)
        found = [(label, self.words(text)) for text, label in aside]
        clean = [s for label, s in found if not label]
        centres = [math.floor((x + 16) * 8) / 8 - 16 + 1 / 16 for s in clean for x in s]
        low, high = 1e-3, 64.0
        while high - low > 1e-9:
            mid = (low + high) / 2
            low, high = (mid, high) if np.mean(np.exp(mid * np.array(centres))) < 1 else (low, mid)
        self.lam = low
        self.k = 1 / np.mean([len(s) * math.exp(-self.lam * max([0.0, *positive_runs(s)])) for s in clean if s])
        self.rows = [(label, *self.evidence(s)) for label, s in found]

    def words(self, text):
        out = []
        for whole, six, four in zip(*slots(tokens_of(text))):
            rho = self.base
            for k, strength in zip((four, six, whole), STRENGTH):
                rho = (self.counts[1, k] + strength * rho) / (self.counts[:, k].sum() + strength)
            rho = min(1 - 1e-9, max(1e-9, rho))
            out.append(math.log(rho / (1 - rho)) - math.log(self.base / (1 - self.base)) - SHIFT)
        return out

    def evidence(self, scores):
        over = [self.lam * s - math.log(self.k * max(len(scores), 1)) for s in positive_runs(scores)]
        return math.asinh(sum(x for x in over if x > 0)), min(10.0, max(-10.0, max(over, default=-10.0)))


def corpus():
    rng = np.random.default_rng(8)
    calm, vile = [f"calm{k}" for k in range(30)], ["vile", "vilely", "foul", "rotten"]
    rows = []
    for k in range(90):
        words = list(rng.choice(calm, int(rng.integers(8, 40))))
        if k % 3 == 0:
            at = int(rng.integers(0, len(words)))
            words[at:at] = list(rng.choice(vile, int(rng.integers(1, 7))))
        elif k % 4 == 1:  # clean texts hold such words now and then, so chance has a law
            words[3] = str(rng.choice(vile))
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    return rows + [(200, "", 0), (201, "vile vile vile", None), (202, "calm1 unseen", None)]


def test_score_from_counts_to_probability(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    aside = {r._label_id: r._aside for r in labelled(marks, F.lit(False), 1000, "doc_id", "toxic").collect()}
    plain = Plain([(t, y) for i, t, y in rows if y is not None and not aside[i]], [(t, y) for i, t, y in rows if y is not None and aside[i]])
    model = learn(docs, marks, F.lit(False))
    assert abs(model.lam - plain.lam) < 1e-6 and abs(model.k / plain.k - 1) < 1e-6
    x = np.array([(a, b, 1.0) for _, a, b in plain.rows])
    y = np.array([label for label, _, _ in plain.rows])
    beta = np.array(model.curve)
    ridge = np.array([0.01, 0.01, 1e-6])
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ beta))) - ridge * beta
    free = beta > 0
    free[2] = True
    assert np.abs(slope[free]).max() < 2e-2 and (slope[~free] < 1).all()  # the least loss under slopes that aren't negative
    for r in toxic_scores(docs, model).collect():
        a, b = plain.evidence(plain.words(dict((i, t) for i, t, _ in rows)[r.doc_id]))
        assert abs(r.score - 1 / (1 + math.exp(-(beta @ [a, b, 1.0])))) < 1e-6


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pipeline_stages_of_toxicity_and_packing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.length("text") < 1500)
    kept = {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, DATA).collect()}
    marks = spark.read.parquet(f"{DATA}/labels.parquet")
    model = learn(docs, marks, remainder(F.col("_label_id"), 5) == 0)
    want = set()
    for r in docs.collect():
        scores = [float(s) for s in model.scores(tokens_of(r.text or ""))] if tokens_of(r.text or "") else []
        over = [model.lam * s - math.log(model.k * max(len(scores), 1)) for s in positive_runs(scores)] if len(scores) < 400 else [model.lam * s - math.log(model.k * len(scores)) for _, _, s in toxicity.segments(np.array(scores))]
        z = np.dot(model.curve, [math.asinh(sum(x for x in over if x > 0)), min(10.0, max(-10.0, max(over, default=-10.0))), 1.0])
        if 1 / (1 + math.exp(-z)) < 0.5:
            want.add(r.doc_id)
    assert kept == want and len(want) < docs.count()

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    room: list[int] = []
    for n in sorted((r.length for r in packed), reverse=True):
        fits = [free for free in room if free >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(4096 - n)
    assert len({r.sequence_id for r in packed}) == len(room)
    for s in {r.sequence_id for r in packed}:
        at = 0
        for r in sorted((r for r in packed if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
