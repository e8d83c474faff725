"""Pictures against one pass in order, typed payloads with nulls, sketches within their error."""

import random

from pyspark.sql import functions as F

from tidewell.functions import payload
from tidewell.functions.urls import practical_reject
from tidewell.operators.pictures import accepted, unlike
from tidewell.operators.sketches import density_gain, distinct_sketches, merged


def test_pictures_equal_one_pass(spark):
    rng = random.Random(9)
    bases = [rng.getrandbits(64) - (1 << 63) for _ in range(25)]
    rows = []
    for k in range(500):
        h = rng.choice(bases) & ((1 << 64) - 1)
        for _ in range(rng.randrange(0, 7)):
            h ^= 1 << rng.randrange(64)
        rows.append((k, rng.randrange(3), h - (1 << 64) if h >> 63 else h))
    kept: dict[int, list] = {}
    for k, doc, h in rows:
        mine = kept.setdefault(doc, [])
        if all(bin((h ^ x) & ((1 << 64) - 1)).count("1") > 4 for _, x in mine):
            mine.append((k, h))
    frame = spark.createDataFrame(rows, "i long, doc int, h long").repartition(3)
    assert sorted(r.i for r in unlike(frame, ["doc"], "i", "h").collect()) == sorted(k for m in kept.values() for k, _ in m)


def test_many_equal_hashes_are_one_row(spark):
    same = spark.range(100_000).select(F.col("id").alias("i"), F.lit(1).alias("doc"), F.lit(77).cast("long").alias("h"))
    assert [r.i for r in unlike(same, ["doc"], "i", "h").collect()] == [0]


def test_shape_and_zone(spark):
    cases = [
        (1, 150, 150, None, None, None, True), (2, 149, 300, None, None, None, False), (3, 900, 200, None, None, None, False), (4, 800, 200, None, None, None, True), (5, 200, 0, None, None, None, False),
        (6, None, 200, None, None, None, False), (7, 200, 200, 1000.0, 79.0, 300.0, False), (8, 200, 200, 1000.0, 80.0, 920.0, True), (9, 200, 200, 1000.0, 500.0, 921.0, False), (10, 200, 200, 1000.0, 950.0, None, False), (11, 200, 200, 0.0, 1.0, 1.0, True),
    ]
    frame = spark.createDataFrame([(*c[:6], c[0] * 0x0123456789ABCD) for c in cases], "i int, width int, height int, page_height double, top double, bottom double, h long").withColumn("doc", F.col("i"))
    assert sorted(r.i for r in accepted(frame, ["doc"], "i", "h").collect()) == [c[0] for c in cases if c[-1]]


def test_payload_nulls(spark):
    rows = [(1, '{"a": "x", "n": 3}'), (2, '{"a": null}'), (3, "{}"), (4, "{bad"), (5, None), (6, '{"a": 3, "n": "3"}'), (7, '{"a": {"b": 1}, "n": 2.5, "odd key.": true}')]
    p = spark.createDataFrame(rows, "i int, raw string").select("i", payload.parsed("raw").alias("p"))
    ids = lambda c: sorted(r.i for r in p.where(c).collect())
    assert ids(payload.equals("p", "a", "x")) == [1] and ids(payload.equals("p", "a", "3")) == [6]
    assert ids(payload.among("p", "a", ["x", "3"])) == [1, 6] and ids(payload.among("p", "a", [])) == []
    assert ids(payload.not_among("p", "a", ["x"])) == [6, 7] and ids(payload.not_among("p", "a", [])) == [1, 6, 7]
    assert ids(payload.number_in("p", "n", 2, 4)) == [1, 7] and ids(payload.equals("p", "odd key.", "true")) == [7]
    assert p.where("i = 7").select(payload.field("p", "a")).first()[0] == '{"b":1}'


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("source"), (F.col("id") % 4).alias("day"), (F.col("id") * 7919 % 20_000).alias("user"))
    daily = distinct_sketches(rows, ["source", "day"], "user")
    whole = merged(daily.groupBy("source", "day").agg(F.theta_union_agg("sketch", 12).alias("sketch")), ["source"]).select("source", F.theta_sketch_estimate("sketch").alias("n"))
    exact = {r.source: r.n for r in rows.groupBy("source").agg(F.countDistinct("user").alias("n")).collect()}
    for r in whole.collect():
        assert abs(r.n - exact[r.source]) <= 4 * exact[r.source] / 64  # four standard errors
    small = rows.where("user < 900")
    seen: dict = {}
    for r in sorted(small.select("source", "day", "user").distinct().collect()):
        seen.setdefault(r.source, {}).setdefault(r.day, set()).add(r.user)
    want = []
    for source, days in seen.items():
        known: set = set()
        for day in sorted(days):
            want.append((source, day, len(known | days[day]), len(days[day] - known)))
            known |= days[day]
    assert sorted(map(tuple, density_gain(distinct_sketches(small, ["source", "day"], "user"), ["source"], "day").collect())) == sorted(want)


def test_official_hosts_keep_their_reference_pages(spark):
    urls = ["https://docs.python.org/docs/api/x", "https://other.org/docs/x", "https://www.docs.python.org/api/"]
    got = [r.r for r in spark.createDataFrame([(u,) for u in urls], "u string").select(practical_reject("u", official=["Docs.Python.org"]).alias("r")).collect()]
    assert got[0] is None and got[1].startswith("practical_api_doc_path") and got[2] is None
