"""Ranking and selection over partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(keys: Sequence[str], *order: Column | str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def top_per_group(rows: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(_window(keys, *order))).where(F.col("_rn") <= n).drop("_rn")


def knee_cutoff(rows: DataFrame, keys: Sequence[str], score: str, tie: str, floor: float = 0.30, drop: float = 0.12) -> DataFrame:
    """Rows of each group up to the first drop of at least ``drop`` of the top score, not below the floor.

    A group whose best row is below the floor is empty.
    """
    w = _window(keys, F.desc(score), F.asc(tie))
    top = F.max(score).over(Window.partitionBy(*keys))
    marked = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_top", top)
    marked = marked.withColumn("_drop", F.try_divide(F.col(score) - F.lead(score).over(w), F.col("_top")))
    cut = F.min(F.when(F.col("_drop") >= drop, F.col("_rn"))).over(Window.partitionBy(*keys))
    kept = marked.withColumn("_cut", cut).where((F.col("_top") >= floor) & (F.col(score) >= floor) & (F.col("_cut").isNull() | (F.col("_rn") <= F.col("_cut"))))
    return kept.drop("_rn", "_top", "_drop", "_cut")


def positional_reorder(rows: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """Add ``place``: best first, second best last, the others between."""
    rank = F.row_number().over(_window(keys, F.desc(score), F.asc(tie)))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = rows.withColumn("_r", rank).withColumn("_n", n)
    place = F.when((F.col("_n") > 2) & (F.col("_r") == 2), F.col("_n")).when((F.col("_n") > 2) & (F.col("_r") > 2), F.col("_r") - 1).otherwise(F.col("_r"))
    return ranked.withColumn("place", place.cast("long")).drop("_r", "_n")


def round_robin(rows: DataFrame, keys: Sequence[str], group: str, position: str, cap: int, per_group: int) -> DataFrame:
    """Rows taken in turns over groups in the order of their first row; ``place`` from 1."""
    turn = F.row_number().over(_window([*keys, group], position))
    first = F.min(position).over(Window.partitionBy(*keys, group))
    turns = rows.withColumn("_turn", turn).withColumn("_first", first).where(F.col("_turn") <= per_group)
    placed = turns.withColumn("place", F.row_number().over(_window(keys, "_turn", "_first")).cast("long"))
    return placed.where(F.col("place") <= cap).drop("_turn", "_first")


def fill_tail(selected: DataFrame, rows: DataFrame, keys: Sequence[str], row_key: str, position: str, target: int) -> DataFrame:
    """Selected rows, and others in their order until each group has ``target``."""
    rest = rows.join(selected.select(*keys, row_key), [*keys, row_key], "left_anti").withColumn("_part", F.lit(1)).withColumn("_at", F.col(position).cast("long"))
    both = selected.withColumn("_part", F.lit(0)).withColumn("_at", F.col("place")).unionByName(rest.withColumn("place", F.lit(None).cast("long")))
    placed = both.withColumn("place", F.row_number().over(_window(keys, "_part", "_at")).cast("long"))
    return placed.where(F.col("place") <= target).drop("_part", "_at")


def quota_select(rows: DataFrame, keys: Sequence[str], bucket: str, score: str, tie: str, academic: int, practical: int, total: int) -> DataFrame:
    """Best academic and practical rows up to their quotas, then the other rows until ``total``.

    The filling begins with practical rows if academic ones fall short, else with academic ones.
    """
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rn", F.row_number().over(_window([*keys, bucket], F.desc(score), F.asc(tie))))
    scholarly = F.col(bucket) == "academic"
    ranked = ranked.withColumn("_n", F.sum(scholarly.cast("int")).over(w))
    quota = F.when(scholarly, F.lit(academic)).otherwise(F.lit(practical))
    short = F.col("_n") < academic
    part = F.when(F.col("_rn") <= quota, F.when(scholarly, 0).otherwise(1)).otherwise(F.when(short, F.when(scholarly, 3).otherwise(2)).otherwise(F.when(scholarly, 2).otherwise(3)))
    placed = ranked.withColumn("_part", part).withColumn("place", F.row_number().over(_window(keys, "_part", "_rn")).cast("long"))
    return placed.where(F.col("place") <= total).drop("_rn", "_n", "_part")


def balanced_batches(rows: DataFrame, keys: Sequence[str], position: str, least: int, most: int) -> DataFrame:
    """Add ``batch``: batches of at most ``most``; the one before the last shrinks so that the last has ``least``."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("_i", F.row_number().over(_window(keys, position)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    full, rest = F.floor(F.col("_n") / most), F.col("_n") % most
    short = (rest > 0) & (rest < least) & (full > 0)
    edge = F.when(short, (full - 1) * most + (most - (F.lit(least) - rest))).otherwise(full * most)
    batch = F.when(short & (F.col("_i") >= edge), full).otherwise(F.floor(F.col("_i") / most))
    return numbered.withColumn("batch", batch.cast("long")).drop("_i", "_n")


def registry_rank(rows: DataFrame, keys: Sequence[str], parent: Column, at: str, label: str, terms: str, tie: str) -> DataFrame:
    """Add ``place``: entries of parents first, then the latest, then those whose label holds most of the node's terms."""
    low = F.lower(F.coalesce(F.col(label), F.lit("")))
    marked = rows.withColumn("_text", low).withColumn("_shared", F.size(F.filter(terms, lambda x: F.contains(F.col("_text"), x))))
    order = _window(keys, F.when(parent, 0).otherwise(1), F.desc(at), F.desc("_shared"), F.asc(tie))
    return marked.withColumn("place", F.row_number().over(order).cast("long")).withColumnRenamed("_shared", "shared").drop("_text")


def collapse_repeats(rows: DataFrame, keys: Sequence[str], position: str, same: Sequence[Column], when: Column) -> DataFrame:
    """Runs of neighbouring rows that agree become their last row; only rows that satisfy ``when`` take part."""
    w = _window(keys, position)
    agree = when
    marked = rows
    for i, c in enumerate([*same, when]):
        marked = marked.withColumn(f"_c{i}", c)
    for i in range(len(same) + 1):
        agree = agree & (F.lag(f"_c{i}").over(w) == F.col(f"_c{i}"))
    marked = marked.withColumn("_run", F.sum(F.when(F.coalesce(agree, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(F.desc(position)))
    return marked.withColumn("_last", last).where("_last = 1").drop("_run", "_last", *[f"_c{i}" for i in range(len(same) + 1)])
