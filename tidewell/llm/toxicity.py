"""Toxic passages as maximum-scoring segments of token log-odds.

Each token's log-odds of standing in a toxic document come from counts in labelled
documents with Dirichlet priors in a chain: a word's prior is what its first six
bytes say, theirs what the first four say, and theirs the share of all tokens.  A
shift makes common tokens negative, and a linear-time scan finds every maximal
segment of positive total (Ruzzo and Tompa).  Segment totals are compared with what
clean text of that length yields by chance: with lambda and K of the extreme-value
law, fitted on clean documents left out of the counts, K n exp(-lambda S) is the
expected number of such segments.  A document's evidence, the sum over segments
that are significant, goes through a logistic curve fitted on the same left-out
documents, toxic ones included.

The labelled sample is bounded by ``max_rows``; token counts live in tables of
fixed size.  Every whole text is scored.

Defined results: null and empty texts have no segments and the score of no
evidence; texts of any length are scored whole; a row without id is scored and, since
no label can name it, not learnt from; rows without label are not learnt from; where there is no toxic or no
clean row to learn from, every score is 0; an id labelled more than once counts as
toxic if one label says so; rows that repeat an id are scored each on its own; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, forget, pack_counters, sum_counters, text_batches

TABLE = 1 << 20
SLICE = 1 << 14
#: Strength of the priors, in tokens: of the share of all tokens, of 4 bytes, of 6 bytes.
STRENGTH = (20.0, 10.0, 4.0)
#: Taken from every token's log-odds.
SHIFT = 0.75
CACHE_WORDS = 250_000

_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def tokens_of(text: str) -> list[bytes]:
    """Words, A-Z lowered, punctuation apart."""
    return text.encode().lower().translate(_SPACED).split()


def slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of words, 6-byte and 4-byte beginnings in the table's three parts."""
    crc, n = zlib.crc32, len(words)
    mask = TABLE - 1
    whole = np.fromiter((crc(w) & mask for w in words), np.int64, n)
    six = np.fromiter((crc(w[:6], 6) & mask for w in words), np.int64, n)
    four = np.fromiter((crc(w[:4], 4) & mask for w in words), np.int64, n)
    return whole, six + TABLE, four + 2 * TABLE


@dataclass
class Model:
    """Counts of clean and toxic tokens, the extreme-value law and the curve."""

    counts: np.ndarray  # [2, 3 * TABLE]
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float, float] | None = None

    def share(self) -> float:
        total = self.counts[:, :TABLE].sum(axis=1).astype(float)
        return float((total[1] + 1) / (total.sum() + 2))

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Shifted log-odds of words."""
        base = self.share()
        rho = np.full(len(words), base)
        for at, strength in zip(reversed(slots(words)), STRENGTH):
            toxic, clean = self.counts[1, at], self.counts[0, at]
            rho = (toxic + strength * rho) / (toxic + clean + strength)
        rho = np.clip(rho, 1e-9, 1 - 1e-9)
        return np.log(rho / (1 - rho)) - np.log(base / (1 - base)) - SHIFT


class WordScores(dict):
    """Scores of words that a worker remembers."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        new = list(set().union(*texts).difference(self)) if texts else []
        self.update(zip(new, self.model.scores(new).tolist()))
        get = self.__getitem__
        out = [np.fromiter(map(get, t), float, len(t)) for t in texts]
        for _ in range(len(self) - CACHE_WORDS):
            self.popitem()
        return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments of positive total: first, last, total; linear in the tokens."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.cumsum(scores)
    after = total[up]
    before = after - scores[up]
    stack: list[tuple[int, int, float, float]] = []  # first, last, total before it, total after it
    for i, lo, hi in zip(up.tolist(), before.tolist(), after.tolist()):
        first, last = i, i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= lo:
                j -= 1
            if j < 0 or stack[j][3] >= hi:
                stack.append((first, last, lo, hi))
                break
            first, lo = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def solve_lambda(scores: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The positive root of mean(exp(lambda s)) = 1 for scores of negative mean; weights are positive."""
    lo, hi = 1e-3, 1.0
    if len(scores) == 0 or scores.max() <= 0 or np.average(scores, weights=weights) >= 0:
        return 1.0
    value = lambda x: float(np.average(np.exp(np.minimum(x * scores, 50)), weights=weights))
    while value(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return (lo + hi) / 2


def features(model: Model, found: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
    """Evidence of significant segments, and how far the best one stands above chance."""
    chance = np.log(model.k * max(n, 1))
    over = [model.lam * s - chance for _, _, s in found]
    return float(np.arcsinh(sum(x for x in over if x > 0))), float(np.clip(max(over, default=-10.0), -10.0, 10.0))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; slopes are not negative."""
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        ridge = np.diag([0.01, 0.01, 1e-6])
        gradient = design.T @ (y - p) - ridge @ beta
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(3), gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    if beta[0] < 0 or beta[1] < 0:  # a higher score must mean more evidence
        keep = 0 if beta[0] >= beta[1] else 1
        design = np.column_stack([x[:, keep], np.ones(len(x))])
        b = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
            b += np.clip(np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.01 * np.eye(2), design.T @ (y - p) - 0.01 * b), -5, 5)
        beta = np.array([max(b[0], 0.0) if keep == 0 else 0.0, max(b[0], 0.0) if keep else 0.0, b[1]])
    return tuple(map(float, beta))


def probability(model: Model, found: list[tuple[int, int, float]], n: int) -> float:
    if model.curve is None:
        return 0.0
    a, b = features(model, found, n)
    z = model.curve[0] * a + model.curve[1] * b + model.curve[2]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def labelled(labels: DataFrame, held_out: Column, max_rows: int, id_col: str, label_col: str) -> DataFrame:
    """At most ``max_rows`` labelled ids outside the held-out ones, and a quarter of them set aside."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_label_id")).agg(F.max(F.col(label_col)).cast("int").alias("_toxic"))
    order = F.xxhash64("_label_id", F.lit(11))
    return known.where(~held_out).orderBy(order, "_label_id").limit(max_rows).withColumn("_aside", F.pmod(F.xxhash64("_label_id", F.lit(12)), F.lit(4)) == 0)


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = 60_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit counts, extreme-value law and curve on a bounded labelled sample; ``held_out`` is an expression on ``_label_id``."""
    spark = docs.sparkSession
    sample = F.broadcast(labelled(labels, held_out, max_rows, id_col, label_col))  # bounded by max_rows
    source = docs.select(F.col(id_col).cast("long").alias("_label_id"), F.col(text_col).alias("text")).join(sample, "_label_id").select("_toxic", "_aside", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts, seen = np.zeros((2, 3 * TABLE), np.int32), False
        for whole in batches:
            for batch, texts in text_batches(whole, "text"):
                for label, text in zip(batch.column("_toxic").to_pylist(), texts):
                    seen = True
                    for at in slots(tokens_of(text)):
                        np.add.at(counts[1 if label else 0], at, 1)
        for k, payload in pack_counters(counts.reshape(-1), SLICE) if seen else ():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([payload], pa.binary())], ["slice", "payload"])

    counts = sum_counters(source.where(~F.col("_aside")).mapInArrow(count, "slice int, payload binary"), 6 * TABLE, SLICE, "int32").reshape(2, 3 * TABLE)
    model = Model(counts)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = WordScores(shared.value)
        for whole in batches:
            for batch, texts in text_batches(whole, "text"):
                rows = []
                for label, s in zip(batch.column("_toxic").to_pylist(), held.of([tokens_of(t) for t in texts])):
                    histogram = np.bincount(np.clip(((s + 16) * 8).astype(int), 0, 255), minlength=256) if not label else np.zeros(256, int)
                    rows.append((int(bool(label)), len(s), [x for _, _, x in segments(s)], histogram.tolist()))
                label, n, found, histogram = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(n, pa.int32()), pa.array(found, pa.list_(pa.float64())), pa.array([np.sum(histogram, axis=0).tolist()] + [None] * (len(rows) - 1), pa.list_(pa.int64()))], ["label", "n", "found", "histogram"])

    aside = cut(source.where("_aside").mapInArrow(measure, "label int, n int, found array<double>, histogram array<long>"))
    rows = aside.select("label", "n", F.array_max("found").alias("best"), "histogram").collect()  # bounded by max_rows / 4 rows
    shared.destroy()
    y = np.array([r.label for r in rows], float)
    if not counts[1].any() or not counts[0].any() or not len(y) or y.min() == y.max():
        model.curve = None if not counts[1].any() or not counts[0].any() else (1.0, 0.0, -2.0)
        return model
    histogram = np.sum([r.histogram for r in rows if r.histogram], axis=0)
    bins = np.flatnonzero(histogram)
    model.lam = solve_lambda((bins + 0.5) / 8 - 16, histogram[bins])
    clean = [(r.n, r.best or 0.0) for r in rows if not r.label and r.n]
    model.k = float(1 / max(1e-12, np.mean([n * np.exp(-model.lam * m) for n, m in clean])))
    law = Model(np.zeros((2, 0)), model.lam, model.k)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(law, [(0, 0, s) for s in found], n) for found, n in zip(batch.column("found").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array([g[i] for g in got], pa.float64()) for i in (0, 1))], ["label", "a", "b"])

    rows = aside.select("label", "n", "found").mapInArrow(evidence, "label int, a double, b double").collect()  # bounded by max_rows / 4 rows
    model.curve = fit_curve(np.array([(r.a, r.b) for r in rows]), np.array([r.label for r in rows], float))
    return model


def toxic_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, passages`` of every row; passages are significant segments as word ranges with their expected number by chance."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = shared.value
        held = WordScores(m)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("expected", pa.float64())]))
        for whole in batches:
            for batch, texts in text_batches(whole, "text"):
                score, passages = [], []
                for s in held.of([tokens_of(t) for t in texts]):
                    found = segments(s)
                    score.append(probability(m, found, len(s)))
                    expected = [(a, b, float(m.k * len(s) * np.exp(-m.lam * x))) for a, b, x in found]
                    passages.append([{"first": a, "last": b, "expected": e} for a, b, e in expected if e < 1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, passages array<struct<first:int,last:int,expected:double>>")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(doc_id.cast("string")) % of


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, remainder(F.col("_label_id"), 5) == 0, id_col=id_col, text_col=text_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = WordScores(shared.value)
        for whole in batches:
            for batch, texts in text_batches(whole, whole.schema.names[place]):
                kept = [probability(shared.value, segments(s), len(s)) < threshold for s in held.of([tokens_of(t) for t in texts])]
                yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
