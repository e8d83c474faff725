"""Packing of rows into bounded bins in their order."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def next_fit(rows: DataFrame, keys: Sequence[str], position: str, cost: str, bound: float) -> DataFrame:
    """``keys, position, bin``: a row that doesn't fit opens the next bin; a larger one has its own.

    A group is one article or batch job; its costs are walked once in order, so long
    groups take linear time.
    """
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(position, T.LongType()), T.StructField("bin", T.LongType())])

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(position, kind="stable")
        bins, at, used = [], -1, float("inf")
        for c in group["_cost"].tolist():
            if used + c > bound:
                at, used = at + 1, c
            else:
                used += c
            bins.append(at)
        return group[[*keys, position]].assign(bin=bins)

    slim = rows.select(*keys, F.col(position).cast("long").alias(position), F.col(cost).cast("double").alias("_cost"))
    return slim.groupBy(*keys).applyInPandas(walk, schema)
