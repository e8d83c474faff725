"""Distinct counts that merge: sketches kept by source and day, united and intersected later without the rows.

Theta sketches of ``2**lg`` entries: up to so many distinct values they are exact, beyond
that the standard error of a union is about ``1 / sqrt(2**lg)``.  A stored row is
bounded by the sketch, however many rows went into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a sketch as a power of two.
LG = 12


def distinct_sketches(rows: DataFrame, keys: Sequence[str], value: str, lg: int = LG) -> DataFrame:
    """``keys, sketch``: one sketch of the values of each key, nulls left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.theta_sketch_agg(value, lg).alias("sketch"))


def merged(sketches: DataFrame, keys: Sequence[str], lg: int = LG) -> DataFrame:
    """Sketches united to coarser keys."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg("sketch", lg).alias("sketch"))


def density_gain(sketches: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``keys, order, seen, new``: distinct values up to each step, and how many of its own were new, from stored sketches alone."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.theta_union_agg("sketch").over(before)
    known = sketches.withColumn("_before", so_far)
    total = F.when(F.col("_before").isNull(), F.theta_sketch_estimate("sketch")).otherwise(F.theta_sketch_estimate(F.theta_union("sketch", "_before")))
    own = F.theta_sketch_estimate("sketch")
    common = F.when(F.col("_before").isNull(), F.lit(0).cast("long")).otherwise(F.theta_sketch_estimate(F.theta_intersection("sketch", "_before")))
    return known.select(*keys, order, total.alias("seen"), (own - common).alias("new"))


def exact_gain(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``keys, order, seen, new`` as ``density_gain`` has them, but exact beyond a sketch's entries: each value counts at its first step.

    One row for each key and value is exchanged; then there is one for each key and step.
    """
    from pyspark.sql import Window

    real = F.col(value).isNotNull()
    first = rows.where(real).groupBy(*keys, value).agg(F.min(order).alias(order))
    new = first.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("new"))
    none = rows.where(real).select(*keys, order).distinct().withColumn("new", F.lit(0).cast("long"))  # steps without a new value
    steps = new.unionByName(none).groupBy(*keys, order).agg(F.sum("new").alias("new"))
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*keys, order, F.sum("new").over(so_far).alias("seen"), "new")
