import zlib

import numpy as np

from tidewell.llm import sharding
from tidewell.llm.sharding import interval_of, shard_documents


def test_intervals_of_pairs():
    bh, bl = np.array([5, 5, 9], np.uint64), np.array([1, 7, 0], np.uint64)
    high, low = np.array([4, 5, 5, 5, 9, 9], np.uint64), np.array([9, 0, 1, 8, 0, 5], np.uint64)
    assert interval_of(high, low, bh, bl).tolist() == [0, 0, 1, 2, 3, 3]


def check(rows, got, n):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(n))
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(n)]
    largest = max(len((t or "").encode()) + 1 for _, t in rows)
    assert max(sizes) - min(sizes) <= 2 * largest + 0.01 * sum(sizes) / n


def test_sizes_are_near_equal_with_a_hot_text(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.integers(0, 400))) for i in range(1200)] + [(5000 + i, "the same text" * 10) for i in range(700)] + [(9, None), (9, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot int").repartition(5)
    got = shard_documents(docs, 8, rows_per_bucket=100).collect()
    check(rows, got, 8)
    carried = shard_documents(docs, 8, rows_per_bucket=100, carry=("slot", "text"))
    assert sorted((r.doc_id, r.doc.text or "") for r in carried.collect()) == sorted((i, t or "") for i, t in rows)


def test_one_text_only_and_empty(spark):
    rows = [(i, "same") for i in range(300)]
    check(rows, shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect(), 4)
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_partitions_follow_the_rows_and_not_the_shards(spark, monkeypatch):
    """Few probes a round, many partitions a shard, a hot text over several of them, repeated rows."""
    monkeypatch.setattr(sharding, "PROBES", 64)
    rng = np.random.default_rng(8)
    rows = [(i, "y" * int(rng.integers(0, 300))) for i in range(900)] + [(i % 50, "a hot text " * 12) for i in range(600)] + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for carry in ((), ("text",)):
        for bound in (1_000_000, 0):
            monkeypatch.setattr(sharding, "BROADCAST_RUNS", bound)
            out = sharding.shard_documents(docs, 3, rows_per_bucket=40, carry=carry, bytes_per_bucket=5000)
            check([(-1 if i is None else i, t) for i, t in rows], out.fillna(-1, ["doc_id"]).collect(), 3)
    whole = sharding.shard_documents(docs, 3, rows_per_bucket=40)
    assert len({(r.doc_id, r.shard, r.slot) for r in whole.collect()}) == len(rows)
