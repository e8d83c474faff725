"""Sharding into near-equal byte sizes by histogram sort.

Rows are ordered by (hash of the text, hash of the row), so equal texts lie
together.  Splitters start as the whole key space; each round counts the exact
bytes and rows between candidate boundaries over all partitions and narrows
every splitter's bracket, until it meets its byte target within the tolerance or
stands between two neighbouring rows.  The counts of a round are bounded by the
number of probes.  Then rows move once, by range of the same order, into as many
partitions as their number asks for, whatever the number of shards, and are written.
A row's slot is its place in its partition plus the rows of the shard in earlier
partitions; that takes one row for each partition and shard in it.  A text that a third
of all rows share is split by the row hash like any other range.

Defined results: a null text counts as none (size 1, crc32 0); texts of any length
count whole, and a shard that one of them fills alone is larger by it; a row without
id is placed like any other; repeated rows are rows of their own; an empty table
gives an empty result; other columns are ignored, whatever their names, or carried
in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, with_row_key

#: Probes of one round over all splitters.
PROBES = 4096
#: Most partitions of the exchange whose row counts are broadcast; 20 bytes each.
BROADCAST_RUNS = 1_000_000

FLIP = np.uint64(1 << 63)
HALF = 1 << 64


def _unsigned(column: pa.Array) -> np.ndarray:
    """Signed 64-bit hashes as unsigned ones in the same order."""
    return column.to_numpy().view(np.uint64) ^ FLIP


def interval_of(high: np.ndarray, low: np.ndarray, bound_high: np.ndarray, bound_low: np.ndarray) -> np.ndarray:
    """The number of boundaries at or below each key; boundaries are sorted pairs."""
    left = np.searchsorted(bound_high, high, side="left")
    right = np.searchsorted(bound_high, high, side="right")
    out = right.copy()
    for start in np.unique(left[left < right]):  # keys that share their upper half with a boundary
        rows = np.flatnonzero((left == start) & (right > start))
        stop = right[rows[0]]
        out[rows] = start + np.searchsorted(bound_low[start:stop], low[rows], side="right")
    return out


def _halves(bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([b >> 64 for b in bounds], np.uint64), np.array([b & (HALF - 1) for b in bounds], np.uint64)


def histogram(keys: DataFrame, bounds: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Exact bytes, rows, smallest and largest upper key half between sorted boundaries."""
    high_bound, low_bound = _halves(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(high_bound) + 1
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full(n, HALF - 1, np.uint64), np.zeros(n, np.uint64)
        for batch in batches:
            high = _unsigned(batch.column("high"))
            at = interval_of(high, _unsigned(batch.column("low")), high_bound, low_bound)
            np.add.at(size, at, batch.column("size").to_numpy())
            np.add.at(rows, at, 1)
            np.minimum.at(least, at, high)
            np.maximum.at(most, at, high)
        used = np.flatnonzero(rows)
        signed = lambda x: (x[used] ^ FLIP).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used.astype(np.int32), size[used], rows[used], signed(least), signed(most))], ["at", "size", "n", "least", "most"])

    counted = keys.select("high", "low", "size").mapInArrow(run, "at int, size long, n long, least long, most long")
    summed = counted.groupBy("at").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return {r["at"]: (r["size"], r["n"], r["least"] + HALF // 2, r["most"] + HALF // 2) for r in summed.collect()}


def find_splitters(keys: DataFrame, n_shards: int, total: int, tolerance: float) -> list[int]:
    """Sorted boundaries between the shards, which meet their byte targets within ``tolerance`` of a shard's bytes."""
    bracket = [(0, HALF * HALF)] * n_shards  # of splitter j: keys; splitter 0 is unused
    found: dict[int, int] = {}
    slack = max(1, int(tolerance * total / n_shards))
    while len(found) < n_shards - 1:
        open_ = [j for j in range(1, n_shards) if j not in found]
        each = max(2, PROBES // len({bracket[j] for j in open_}))
        bounds = sorted({lo + (hi - lo) * i // each for lo, hi in {bracket[j] for j in open_} for i in range(1, each + 1)} - {HALF * HALF})
        got = histogram(keys, bounds)
        below = np.cumsum([got.get(i, (0,))[0] for i in range(len(bounds))])
        for j in open_:
            target = total * j // n_shards
            at = int(np.searchsorted(below, target))
            near = min((i for i in (at - 1, at) if 0 <= i < len(bounds)), key=lambda i: abs(int(below[i]) - target))
            lo, hi = (bounds[at - 1] if at else bracket[j][0]), (bounds[at] if at < len(bounds) else bracket[j][1])
            if abs(int(below[near]) - target) <= slack or hi - lo <= 1:
                found[j] = bounds[near]
                continue
            inside = got.get(at)
            if inside:  # no key of the bracket lies outside these
                lo, hi = max(lo, inside[2] << 64), min(hi, (inside[3] + 1) << 64)
            bracket[j] = (lo, hi)
    return sorted(found.values())


def row_boundary(keys: DataFrame, rows: int) -> int:
    """The key that has exactly ``rows`` of the keys (``high, low, size``) below it, counted in rounds.

    Equal keys can't be told apart; then the nearest boundary above is returned.
    """
    lo, hi = 0, HALF * HALF
    while hi - lo > 1:
        bounds = sorted({lo + (hi - lo) * i // PROBES for i in range(1, PROBES + 1)} | {hi - 1} if hi - lo > PROBES else set(range(lo + 1, hi + 1)))
        bounds = [b for b in bounds if b < HALF * HALF]
        got = histogram(keys, bounds)
        below = np.cumsum([got.get(i, (0, 0))[1] for i in range(len(bounds))])
        at = int(np.searchsorted(below, rows))
        if at < len(bounds) and below[at] == rows:
            return bounds[at]
        lo, hi = bounds[at - 1] if at else lo, bounds[at] if at < len(bounds) else hi
        if at in got:
            lo, hi = max(lo, got[at][2] << 64), min(hi, (got[at][3] + 1) << 64)
    return hi


def shard_documents(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.0005, rows_per_bucket: int = 500_000, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), bytes_per_bucket: int = 1 << 28) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` and, in the struct ``doc``, the columns to carry.

    Sizes are UTF-8 bytes plus 1.  The columns named in ``carry`` move with the one
    exchange; the histogram rounds read hashes and sizes only.  A partition of the
    exchange holds some ``rows_per_bucket`` rows and, with ``carry``, not more than some
    ``bytes_per_bucket`` of text, but for a longer text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), *([F.struct(*carry).alias("doc")] if carry else [])))
    source = source.select("doc_id", (F.octet_length("_text") + 1).cast("long").alias("size"), F.crc32(F.encode("_text", "UTF-8")).alias("text_crc32"), F.xxhash64("_text").alias("high"), F.xxhash64("doc_id", "_row").alias("low"), *(["doc"] if carry else []))
    source = cut(source)  # row keys must not change between the histogram and the exchange
    keys = source.drop("doc")
    whole = histogram(keys, [])
    total, n_rows = whole[0][:2] if whole else (0, 0)
    high_bound, low_bound = _halves(find_splitters(keys, n_shards, total, tolerance))
    buckets = max(n_shards, -(-n_rows // rows_per_bucket), -(-total // bytes_per_bucket) if carry else 0)

    moved = source if carry else keys
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moved.schema) + ", shard int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = interval_of(_unsigned(batch.column("high")), _unsigned(batch.column("low")), high_bound, low_bound)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "shard"])

    order = ("high", "low", "doc_id")  # shards are ranges of it
    placed = cut(moved.mapInArrow(run, schema).repartitionByRange(buckets, *order).sortWithinPartitions(*order).drop("high", "low"))
    placed = placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("shard", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    runs = F.broadcast(runs) if buckets <= BROADCAST_RUNS else runs  # at most buckets + n_shards rows
    slotted = placed.join(runs, ["shard", "_part"]).withColumn("slot", F.col("_at") + F.col("_shift"))
    return slotted.select("doc_id", "size", "text_crc32", "shard", "slot", *(["doc"] if carry else []))
