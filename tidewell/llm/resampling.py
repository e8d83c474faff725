"""Quality classifier by importance resampling.

Two generative models of hashed word unigrams and bigrams, one of target text and
one of all raw text, give each document the log of its importance weight: the sum
over its n-grams of the log ratio of their probabilities.  Adding Gumbel noise and
taking the k largest draws k documents without replacement in proportion to their
weights.

The raw model counts every document; the target model counts good documents of a
labelled sample bounded by ``max_rows``.  Counters have a fixed size.  The k-th
largest key is found by counting rows between probes, round by round, so nothing is
sorted or gathered.

By default k is what the labels say: the rows times the upper bound of the good
share among labelled rows, so that clean text isn't cut for the estimate's sake.

Defined results: a null or empty text has weight 0 in the log; texts of any length
are weighed whole; a row without id is weighed and drawn like any other, but no label
names it; without good labelled
rows every weight is 0 and the noise alone decides; the noise depends on id, seed
and the row's text, so repeated rows share it; ties at the boundary go by a hash of
the row; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, forget, pack_counters, sum_counters, text_batches, with_row_key
from tidewell.llm.sharding import HALF, row_boundary

#: Buckets of hashed n-grams.
BUCKETS = 1 << 17
SLICE = 1 << 13
#: Added to every bucket's count.
SMOOTHING = 1.0
CACHE_WORDS = 500_000

TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")


class Buckets(dict):
    """Hashes of tokens that a worker remembers."""

    def __missing__(self, token: bytes) -> int:
        h = zlib.crc32(token)
        if len(self) < CACHE_WORDS:
            self[token] = h
        return h


def features(text: str, held: Buckets) -> np.ndarray:
    """Buckets of a text's words, punctuation runs and pairs of neighbours."""
    tokens = TOKEN.findall(text.encode().lower())
    h = np.fromiter(map(held.__getitem__, tokens), np.uint64, len(tokens))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pairs ^= pairs >> np.uint64(29)
    return np.concatenate([h, pairs]).astype(np.int64) & (BUCKETS - 1)


def good_share(labels: DataFrame, label_col: str) -> float:
    """Upper bound, at three standard errors, of the good share among labelled rows."""
    got = labels.where(F.col(label_col).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label_col) > 0).cast("long")).alias("good")).first()
    if not got.n:
        return 1.0
    n, p, z = got.n, got.good / got.n, 3.0
    return min(1.0, (p + z * z / (2 * n) + z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def log_ratios(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> np.ndarray:
    """Log of target over raw probability for each bucket."""
    good = labels.where(F.col(id_col).isNotNull() & (F.col(label_col) > 0)).select(F.col(id_col).cast("long").alias("_id")).distinct()
    good = good.orderBy(F.xxhash64("_id", F.lit(21)), "_id").limit(max_rows).withColumn("_good", F.lit(True))
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(good), "_id", "left")  # bounded by max_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, counts = Buckets(), np.zeros((2, BUCKETS), np.int64)
        for whole in batches:
            for batch, texts in text_batches(whole, "text"):
                for good, text in zip(batch.column("_good").to_pylist(), texts):
                    n = np.bincount(features(text, held), minlength=BUCKETS)
                    counts[0] += n
                    if good:
                        counts[1] += n
        for k, payload in pack_counters(counts.reshape(-1), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([payload], pa.binary())], ["slice", "payload"])

    raw, target = sum_counters(source.select("_good", "text").mapInArrow(run, "slice int, payload binary"), 2 * BUCKETS, SLICE).reshape(2, BUCKETS).astype(float)
    if not target.any():
        return np.zeros(BUCKETS)
    log_p = lambda c: np.log(c + SMOOTHING) - np.log(c.sum() + SMOOTHING * BUCKETS)
    return log_p(target) - log_p(raw)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as signed integers of the same order."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 1, max_rows: int = 40_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, log_weight, sample_key, kept`` of every row; ``kept`` marks the k rows drawn."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, max_rows, id_col, text_col, label_col))
    source = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    source = source.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("noise"), F.xxhash64("_row", "doc_id").alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = Buckets()
        for whole in batches:
            for batch, texts in text_batches(whole, "text"):
                weight = np.array([ratios.value[features(t, held)].sum() for t in texts])
                u = ((batch.column("noise").to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
                key = weight - np.log(-np.log(u))
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight), pa.array(key), pa.array(_ordered(-key)), batch.column("low"), pa.array(np.ones(n, np.int64))], ["doc_id", "log_weight", "sample_key", "high", "low", "size"])

    keyed = cut(source.mapInArrow(run, "doc_id long, log_weight double, sample_key double, high long, low long, size long"))
    rows = keyed.count()
    k = min(rows, math.ceil(rows * good_share(labels, label_col)) if k is None else k)
    if k == rows:
        return keyed.select("doc_id", "log_weight", "sample_key", F.lit(True).alias("kept"))
    edge = row_boundary(keyed, k)
    high, low = (edge >> 64) - HALF // 2, (edge & (HALF - 1)) - HALF // 2
    below = (F.col("high") < F.lit(high)) | ((F.col("high") == F.lit(high)) & (F.col("low") < F.lit(low)))
    return keyed.select("doc_id", "log_weight", "sample_key", below.alias("kept"))
