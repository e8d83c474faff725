"""Allocation of ids and registries of sources."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators.matching import allocate_ids, number_rows, patch_registry


def patched(spark, registry, new, mapped=(), cap=32):
    old = spark.createDataFrame([(1, i, n, u) for i, (n, u) in enumerate(registry)], "c int, at long, id long, url string")
    rows = spark.createDataFrame([(1, i, u) for i, u in enumerate(new)], "c int, at long, url string")
    pins = spark.createDataFrame([(1, m) for m in mapped], "c int, id long")
    ids, after = patch_registry(old, rows, pins, ["c"], "url", "id", "at", cap)
    return [r.id for r in ids.orderBy("at").collect()], [r.id for r in after.orderBy("place").collect()]


def brute(registry, new, mapped, cap=32):
    key = lambda u: (u or "").strip().rstrip("/").lower()
    known = {key(u): n for n, u in registry if key(u)}
    used, order, nxt, out = {n for n, _ in registry}, [n for n, _ in registry], len(registry) + 1, []
    for u in new:
        k = key(u)
        if k and k in known:
            out.append(known[k])
            continue
        while nxt in used:
            nxt += 1
        used.add(nxt)
        order.append(nxt)
        out.append(nxt)
        if k:
            known[k] = nxt
    if len(order) > cap:
        pins = [n for n in order if n in mapped]
        order = pins + [n for n in order if n not in mapped][: max(0, cap - len(pins))]
    return out, order


def test_new_urls_take_numbers_in_order(spark):
    assert patched(spark, [], ["https://a.b/x", "https://c.d/y"]) == ([1, 2], [1, 2])


def test_a_known_url_keeps_its_number(spark):
    assert patched(spark, [(1, "https://a.b/x")], ["https://A.b/x/", "https://new"]) == ([1, 2], [1, 2])


def test_no_number_is_given_twice(spark):
    assert patched(spark, [(1, "https://a"), (3, "https://c")], ["https://n"]) == ([4], [1, 3, 4])


def test_a_repeated_new_url_is_one_entry_and_blank_ones_are_not(spark):
    assert patched(spark, [], ["http://n/", "HTTP://N", "", None, " "]) == ([1, 1, 2, 3, 4], [1, 2, 3, 4])


def test_the_cap_spares_mapped_entries(spark):
    ids, after = patched(spark, [(i, f"https://e/{i}") for i in range(1, 33)], ["https://e/new"], mapped=[2, 33])
    assert ids == [33] and len(after) == 32 and after[:2] == [2, 33] and 32 not in after


def test_equals_brute_force(spark):
    rng = random.Random(3)
    for _ in range(4):
        registry = [(n, f"http://h/{rng.randrange(12)}" + rng.choice(("", "/"))) for n in rng.sample(range(1, 20), rng.randrange(1, 9))]
        new = [rng.choice(("", f"HTTP://h/{rng.randrange(30)}", f"http://h/{rng.randrange(30)}//")) for _ in range(14)]
        mapped = rng.sample(range(1, 25), 4)
        assert patched(spark, registry, new, mapped, cap=12) == brute(registry, new, mapped, cap=12)


@pytest.mark.parametrize("advisory", [None, "64k"])
def test_numbering_loses_no_row(spark, advisory):
    """Many partitions of unequal width, under default and small advisory sizes."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        if advisory:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        rows = spark.range(0, 60_000, numPartitions=13).select((F.col("id") * 7919 % 60_000).alias("at"), F.when(F.col("id") < 3000, F.repeat(F.hex("id"), 200)).otherwise(F.hex("id")).alias("wide"))
        got = number_rows(rows, "at", "n")
        assert got.count() == 60_000
        assert got.agg(F.count_distinct("n").alias("d"), F.max("n").alias("m"), F.sum((F.col("n") != F.col("at") + 1).cast("int")).alias("wrong")).first() == (60_000, 60_000, 0)
        registry = rows.where("at % 100 = 0").select(F.col("wide").alias("k"), F.col("at").alias("id"))
        new = rows.select(F.col("wide").alias("k"), "at").union(rows.where("at % 3 = 0").select("wide", F.col("at") + 60_000)).union(spark.range(5).select(F.lit(None), F.col("id") + 200_000))
        given = allocate_ids(registry, new, "k", "id", "at")
        assert given.count() == new.count() == 80_005
        assert given.where("k IS NOT NULL").groupBy("k").agg(F.count_distinct("id").alias("d")).where("d <> 1").count() == 0
        assert given.select("id").distinct().count() == 60_005
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
