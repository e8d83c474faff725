"""Connected components of an undirected graph given as pairs of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node with a link; the component is its smallest node.

    Each round gives every node the least label among its own and its neighbours'
    and then the label of that label, so labels jump and long chains take
    logarithmically many rounds.  Labels are summed up per key before they move, and
    every round is cut to the shared checkpoint folder.
    """
    both = cut(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).where("x <> y").distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut(low.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        if not new.where("label <> old").limit(1).count():
            return new.select("node", F.col("label").alias("component"))
        labels = new.drop("old")
