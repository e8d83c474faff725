"""Queues examined in batches, job states and leases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replenish(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], passes: str, batch: int, want: int) -> DataFrame:
    """The first ``want`` rows that pass, as far as the batch that completes them."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rn", F.row_number().over(w.orderBy(*order)))
    good = F.sum(F.col(passes).cast("int")).over(w.orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0))
    marked = ranked.withColumn("batch", F.floor((F.col("_rn") - 1) / batch)).withColumn("_good", good)
    return marked.where(F.col(passes) & (F.col("_good") <= want)).drop("_rn", "_good")


def latest_state(log: DataFrame, key: str, status: str, at: str, tie: str) -> DataFrame:
    """Last status of each job with its first and last time."""
    order = F.struct(at, tie)
    return log.groupBy(key).agg(F.max_by(status, order).alias(status), F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.max_by(tie, order).alias(tie))


def claim(jobs: DataFrame, pending: Column, n: int, *order: str) -> DataFrame:
    """The oldest pending jobs."""
    return jobs.where(pending).orderBy(*order).limit(n)


def recover(jobs: DataFrame, status: str, at: str, now: Column, limit_seconds: int, running: str, to: str) -> DataFrame:
    """Jobs that have run for longer than the limit get another status; adds ``stale``."""
    stale = (F.col(status) == running) & (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) > limit_seconds * 1_000_000)
    return jobs.withColumn("stale", stale).withColumn(status, F.when(F.col("stale"), to).otherwise(F.col(status)))


def requeue(jobs: DataFrame, status: str, error: str, running: str, to: str) -> DataFrame:
    """At a worker's start every running job is an orphan: it is queued again and its error cleared; adds ``requeued``."""
    orphan = F.coalesce(F.col(status) == running, F.lit(False))
    return jobs.withColumn("requeued", orphan).withColumn(error, F.when(~F.col("requeued"), F.col(error))).withColumn(status, F.when(F.col("requeued"), to).otherwise(F.col(status)))


def moving_factor(rows: DataFrame, keys: Sequence[str], at: str, value: str, start: float, share: float) -> DataFrame:
    """Exponential moving average of each group's values in order: ``factor`` after the last.

    The n-th value from the end has the weight ``share * (1 - share)**(n - 1)`` and the
    start what is left, so values are ranked and summed, never gathered.  Equal times
    go by value.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(value))
    ranked = rows.select(*keys, F.col(value).cast("double").alias("_x"), F.row_number().over(w).alias("_back"))
    total = F.sum(F.lit(share) * F.pow(F.lit(1.0 - share), F.col("_back") - 1) * F.col("_x"))
    return ranked.groupBy(*keys).agg((F.lit(start) * F.pow(F.lit(1.0 - share), F.count(F.lit(1))) + total).alias("factor"))
