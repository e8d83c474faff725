"""Search providers by name, each a function of a query table.

A provider takes ``query_id, query`` and returns ``query_id, url, title, score``.
Network providers are out of scope; ``table_provider`` searches a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.texts import overlap, tokens
from tidewell.functions.urls import strip_slash
from tidewell.operators.dedup import cut
from tidewell.operators.ranking import top_per_group
from tidewell.operators.tables import latest

Provider = Callable[[DataFrame], DataFrame]


class Registry:
    """Providers in the order of registration."""

    def __init__(self) -> None:
        self.providers: dict[str, Provider] = {}

    def register(self, name: str, provider: Provider) -> None:
        self.providers[name] = provider

    def search(self, queries: DataFrame, names: list[str] | None = None) -> DataFrame:
        """Hits of all providers, one row for each query and URL: the first provider's."""
        found = None
        for i, name in enumerate(names or self.providers):
            hits = self.providers[name](queries).withColumn("provider", F.lit(name)).withColumn("_i", F.lit(i))
            found = hits if found is None else found.unionByName(hits)
        return latest(found.withColumn("_key", strip_slash("url")), ["query_id", "_key"], F.asc("_i"), F.desc("score"), F.asc("url")).drop("_key", "_i")


def table_provider(rows: DataFrame, url: str, title: str, limit: int, least: int = 3, common: int = 1000) -> Provider:
    """Rows by the number of distinct words that their title shares with the query, ties by address.

    Rows meet queries by equality of words that at most ``common`` titles hold, and are
    scored by all their words.  A row that shares only commoner words with a query counts
    what any row with the same common words counts, so the first ``limit`` addresses
    stand for all rows of such a class, and classes of queries meet classes of rows.
    No hit is lost, and no word makes all rows meet all queries.
    """

    def search(queries: DataFrame) -> DataFrame:
        q = queries.select("query_id", tokens("query", least).alias("_q")).distinct()
        r = cut(rows.select(F.col(url).alias("url"), F.col(title).alias("title"), tokens(title, least).alias("_w")).distinct())
        row, asked = r.withColumn("_t", F.explode("_w")), q.withColumn("_t", F.explode("_q"))
        frequent = cut(row.groupBy("_t").count().where(F.col("count") > common).select("_t"))
        met = asked.join(frequent, "_t", "left_anti").join(row.join(frequent, "_t", "left_anti"), "_t").drop("_t").distinct()
        found = met.select("query_id", "url", "title", overlap(F.col("_q"), F.col("_w")).cast("double").alias("score"))
        if not frequent.isEmpty():
            found = found.unionByName(_by_common_words(asked.join(frequent, "_t"), row.join(frequent, "_t"), limit))
            found = found.groupBy("query_id", "url", "title").agg(F.max("score").alias("score"))
        return top_per_group(found, ["query_id"], limit, F.desc("score"), F.asc("url"), F.asc("title"))

    return search


def _by_common_words(asked: DataFrame, row: DataFrame, limit: int) -> DataFrame:
    """The first hits of each query by common words alone, from one row a query and word and one a title and word."""
    words = F.array_sort(F.collect_set("_t"))
    asked = asked.groupBy("query_id", "_q").agg(words.alias("_asked"))
    first = cut(top_per_group(row.groupBy("url", "title").agg(words.alias("_held")), ["_held"], limit, F.asc("url"), F.asc("title")))
    left = asked.select("_asked").distinct().withColumn("_t", F.explode("_asked"))
    right = first.groupBy("_held").agg(F.min("url").alias("_url")).withColumn("_t", F.explode("_held"))
    shared = left.join(right, "_t").groupBy("_asked", "_held", "_url").agg(F.count(F.lit(1)).cast("double").alias("score"))
    best = top_per_group(shared, ["_asked"], limit, F.desc("score"), F.asc("_url"))  # the first of as many classes precede all others
    return asked.join(best, "_asked").join(first, "_held").select("query_id", "url", "title", "score")
