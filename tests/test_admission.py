"""Admission: the literals of the rule, brute force over whole lists, batch and stream alike."""

import random

from pyspark.sql import functions as F

from tidewell.operators.admission import NAP, SLACK, Ledger, admit, admit_stream
from tidewell.streaming.run import drain, stream_folder

SCHEMA = "key string, seq long, ts double, kind string, prompt long, output long, actual_prompt long, cached long, completion long, warm boolean"


def test_literals():
    one = Ledger(100, 100_000, 60.0)
    assert one.take(0.0, "reserve", 10_000, 0, 0, 0, 0, False) == (0.0, 0.0, 10_000, 1, 10_000, 1.0)
    assert one.take(1.0, "reconcile", 10_000, 0, 10_000, 9_000, 0, False)[3:5] == (1, 1_000)
    half = Ledger(100, 100_000, 60.0, factor=0.5)
    assert half.take(0.0, "reserve", 10_000, 2_000, 0, 0, 0, False)[2] == 7_000
    assert half.take(0.0, "reserve", 10_000, 2_000, 0, 0, 0, True)[2:5] == (0, 1, 7_000)
    moved = Ledger(100, 10**7, 60.0)
    for _ in range(40):
        before = moved.factor
        moved.take(0.0, "reserve", 1000, 0, 0, 0, 0, False)
        assert moved.take(0.0, "reconcile", 1000, 0, 1000, 900, 0, False)[5] < before
    assert abs(moved.factor - 0.1) < 1e-3


def test_waits():
    full = Ledger(2, 1000, 60.0)
    full.take(0.0, "reserve", 10, 0, 0, 0, 0, False)
    full.take(5.0, "reserve", 10, 0, 0, 0, 0, False)
    waited, admitted, *_ = full.take(10.0, "reserve", 10, 0, 0, 0, 0, False)
    assert abs(waited - (NAP + SLACK + 60 - 40.05 + SLACK)) < 1e-9 and abs(admitted - 60.05) < 1e-9  # two naps until the first slot is free
    assert full.take(11.0, "reserve", 10, 0, 0, 0, 0, False)[1] > 60.05  # its caller was still waiting
    assert full.take(200.0, "reserve", 2000, 0, 0, 0, 0, False)[2:5] == (0, 0, 0)  # can never be admitted


def plainly(events, max_requests, max_tokens, window):
    """All events of a key kept in lists and summed anew each time."""
    out, clock, factor, reserved = [], float("-inf"), 1.0, []
    for _, seq, at, kind, prompt, output, actual, cached, completion, warm in sorted(events, key=lambda e: (e[2], e[1])):
        waited, admitted, cost = 0.0, at, 0
        if kind == "reserve" and not warm:
            now = begun = max(at, clock)
            cost = max(1, round(prompt * factor) + output)
            if cost > max_tokens:
                admitted, cost = None, 0
            else:
                while True:
                    live = [r for r in reserved if r[0] > now - window]
                    waits = [live[0][0] + window - now] if len(live) >= max_requests else []
                    if sum(r[1] for r in live) + cost > max_tokens:
                        waits.append(next(live[i][0] + window - now for i in range(len(live)) if sum(r[1] for r in live[i + 1 :]) + cost <= max_tokens))
                    if not waits or max(waits) <= 0:
                        break
                    now += min(max(waits), NAP) + SLACK
                clock, waited, admitted = now, now - begun, now
                reserved.append([now, cost])
        elif kind == "reconcile" and not warm:
            clock = max(at, clock)
            live = [r for r in reserved if r[0] > clock - window] or []
            if reserved and reserved[-1][0] > last_forgotten(out, window):
                reserved[-1][1] = max(1, max(0, actual - cached) + completion)
            factor = 0.8 * factor + 0.2 * max(0, actual - cached) / prompt if prompt else factor
        now = max(at, clock)
        live = [r for r in reserved if r[0] > now - window]
        out.append((seq, round(waited, 6), None if admitted is None else round(admitted, 6), cost, len(live), sum(r[1] for r in live), round(factor, 9), now))
    return [o[:7] for o in out]


def last_forgotten(out, window):
    return max((o[7] for o in out), default=float("-inf")) - window


def events(seed, n=160):
    rng, rows, at = random.Random(seed), [], {}
    for k in range(n):
        key = rng.choice(["a", "b", "hot", "hot"])
        at[key] = at.get(key, 0.0) + rng.choice([0.0, 1.0, 7.5, 20.0])
        kind = rng.choice(["reserve", "reserve", "reconcile"])
        prompt = rng.choice([0, 40, 120, 400])
        rows.append((key, k, at[key], kind, prompt, rng.choice([0, 30]), rng.choice([0, prompt]), rng.choice([0, 20]), rng.choice([0, 10]), rng.random() < 0.1))
    return rows


def got(frame):
    return sorted((r.key, r.seq, round(r.waited, 6), None if r.admitted != r.admitted or r.admitted is None else round(r.admitted, 6), r.reserved, r.requests, r.tokens, round(r.factor, 9)) for r in frame.collect())


def test_batch_and_stream_equal_brute_force(spark, tmp_path):
    rows = events(4)
    want = sorted((key, *o) for key in ("a", "b", "hot") for o in plainly([r for r in rows if r[0] == key], 4, 500, 60.0))
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("ts"))
    assert got(admit(frame.repartition(3), ["key"], ["seq"], F.col("ts"), 4, 500)) == want
    source = str(tmp_path / "in")
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], SCHEMA).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = stream_folder(spark, source, frame)
    assert got(drain(admit_stream(stream, ["key"], ["seq"], F.col("ts"), 4, 500))) == want
