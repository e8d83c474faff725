"""Streaming forms of trailing sums, job states and stage events.

Each takes a streaming DataFrame and returns one; the batch operators in
``tidewell.operators`` define what they compute.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Job statuses that end a job (fixed values).
FINAL = ("completed", "failed")


def minute_usage(events: DataFrame, at: str, key: str, amount: str, late: str = "10 minutes") -> DataFrame:
    """Requests and amounts of each key by minute; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 minute").alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total")).select(F.col("w.start").alias("minute"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events without a longer gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def distinct_submissions(jobs: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One row for each active submission: later equal ones within the watermark are the same job."""
    return jobs.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def job_states(events: DataFrame, key: str, status: str, at: str, stale: str | None = "7200 seconds") -> DataFrame:
    """Status changes of each job: only forward steps are taken, a job that runs too long is queued again.

    Without ``stale`` no timer runs, and a stream over given files can end.

    Output: ``key, status, step``, one row a change.
    """
    allowed = {None: {"pending"}, "pending": {"running", "failed"}, "running": {"completed", "failed", "pending"}}
    limit = int(pd.Timedelta(stale).total_seconds() * 1000) if stale else 0

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            now, n = state.get
            if now == "running":
                state.update(("pending", n + 1))
                yield pd.DataFrame({key: [k[0]], status: ["pending"], "step": [n + 1]})
            return
        now, n = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        for s in rows[status]:
            if s in allowed.get(now, ()):
                now, n = s, n + 1
                out.append((k[0], s, n))
        state.update((now, n))
        if limit and now == "running":
            state.setTimeoutDuration(limit)
        yield pd.DataFrame(out, columns=[key, status, "step"])

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, status, at).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {status} string, step long", "now string, n long", "append", "ProcessingTimeTimeout" if limit else "NoTimeout")
