"""Search hits ranked by engine score and URL quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ranking import top_per_group


def url_quality(url: Column, good: dict[str, int], bad: dict[str, int]) -> Column:
    """Sum of the marks of the parts that a URL holds."""
    low = F.lower(url)
    return sum((F.when(F.contains(low, F.lit(k)), v).otherwise(0) for k, v in {**good, **bad}.items()), F.lit(0))


def blend_hits(rows: DataFrame, keys: Sequence[str], url: str, engine: str, tie: str, good: dict[str, int], bad: dict[str, int], cap: int) -> DataFrame:
    """Best hits by 0.65 engine score and 0.35 quality; hits of quality -5 or less go unless a group has no others.

    A missing engine score counts one half.
    """
    quality = url_quality(F.col(url), good, bad)
    share = F.when(F.col(engine).isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(engine))))
    scored = rows.withColumn("_q", quality)
    scored = scored.withColumn("score", F.round(0.65 * share + 0.35 * (F.least(F.lit(10), F.greatest(F.lit(-10), F.col("_q"))) + 10) / 20.0, 6))
    scored = scored.withColumn("_good", F.count_if(F.col("_q") > -5).over(Window.partitionBy(*keys)))
    return top_per_group(scored.where("_q > -5 OR _good = 0"), keys, cap, F.desc("score"), F.asc(tie)).drop("_q", "_good")
