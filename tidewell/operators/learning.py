"""Aggregates over learner, queue and log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(flag: Column, among: Column) -> Column:
    """Whether every row among some holds a flag; false if there is none."""
    return F.coalesce(F.bool_and(F.when(among, flag)), F.lit(False))


def peak_and_top(score: str, n: int) -> Column:
    """The best score and the mean of the n best; a group's list is one hit's paragraphs."""
    best = F.slice(F.sort_array(F.collect_list(score), asc=False), 1, n)
    return F.struct(F.max(score).alias("peak"), (F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)).alias("top"))


def coverage_summary(rows: DataFrame, keys: Sequence[str], verified: Column, layers: dict[str, Column]) -> DataFrame:
    """Verified rows, the share that passes each layer, and the mean share in percent."""
    shares = rows.groupBy(*keys).agg(F.count_if(verified).alias("verified"), *[F.avg(c.cast("int")).alias(k) for k, c in layers.items()])
    percent = 100 * sum((F.col(k) for k in layers), F.lit(0.0)) / len(layers)  # divided last, else halves fall below themselves
    overall = F.greatest(F.lit(0), F.least(F.lit(100), F.round(percent))).cast("long")
    return shares.select(*keys, "verified", *[F.round(k, 6).alias(k) for k in layers], overall.alias("overall"))


def peak_concurrency(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Most spans of a group open at once; an end at the time of a start comes first."""
    opened = spans.select(*keys, F.col(start).alias("at"), F.lit(1).alias("step"))
    closed = spans.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("step"))
    steps = opened.unionByName(closed).groupBy(*keys, "at", "step").agg(F.sum("step").alias("change"))  # equal times become one row
    w = Window.partitionBy(*keys).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("open", F.sum("change").over(w)).groupBy(*keys).agg(F.max("open").cast("long").alias("peak"))


def capped_registry(rows: DataFrame, keys: Sequence[str], pinned: Column, position: str, cap: int) -> DataFrame:
    """Pinned rows and the first others up to the cap; of too many pinned ones, the last."""
    w = Window.partitionBy(*keys)
    marked = rows.withColumn("_p", pinned)
    marked = marked.withColumn("_np", F.count_if("_p").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.when(F.col("_p"), 0).otherwise(1), position)))
    marked = marked.withColumn("_back", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(F.desc(position))))
    keep = F.when(F.col("_np") > cap, F.col("_p") & (F.col("_back") <= cap)).otherwise(F.col("_rn") <= cap)
    return marked.where(keep).drop("_p", "_np", "_rn", "_back")


def rolling(rows: DataFrame, keys: Sequence[str], at: str, seconds: int, amounts: dict[str, Column]) -> DataFrame:
    """Trailing sums over a half-open window: what is exactly ``seconds`` old no longer counts."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return rows.withColumn("_at", micros).withColumns({k: F.sum(c).over(w) for k, c in amounts.items()}).drop("_at")
