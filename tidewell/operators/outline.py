"""Outlines: the tree of a document's headings, their paragraphs, and the section of any place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain_title(text: Column | str) -> Column:
    """Lower case, without a leading number, white space made one."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^\d+(\.\d+)*[.)]?\s+", ""), r"\s+", " "))


def heading_tree(headings: DataFrame, keys: Sequence[str], place: str, level: str, title: str, levels: int = 6) -> DataFrame:
    """Headings with ``parent`` (the place of the nearest earlier one of a lower level) and ``path`` (titles from the root).

    What a stack of open headings would hold is, for each level, the last heading so far;
    of these the ones later than all of lower levels are open.  So one window a level
    gives parent and path, and nothing is gathered.
    """
    w = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == k, F.struct(F.col(place).alias("at"), F.col(title).alias("title"))), ignorenulls=True).over(w) for k in range(1, levels)]
    seen = headings.withColumns({f"_last{k}": c for k, c in enumerate(last, 1)})
    below: list[Column] = []
    opened = []
    for k in range(1, levels):
        at = F.col(f"_last{k}.at")
        later = F.lit(True)
        for b in below:
            later = later & (b.isNull() | (at > b))
        opened.append(F.when((F.col(level) > k) & at.isNotNull() & later, F.col(f"_last{k}")))
        below.append(at)
    chain = F.filter(F.array(*opened), lambda x: x.isNotNull())
    whole = seen.withColumn("_open", chain)
    return whole.select(*headings.columns, F.try_element_at("_open", F.lit(-1))["at"].alias("parent"), F.concat(F.transform("_open", lambda x: x["title"]), F.array(F.col(title))).alias("path"))


def match_paragraphs(headings: DataFrame, paragraphs: DataFrame, keys: Sequence[str], place: str, title: str, paragraph: str, text: str) -> DataFrame:
    """Headings with ``start``, the paragraph that bears their title; the n-th of equal titles takes the n-th such paragraph.

    Titles and paragraphs meet by equality of their plain form; a heading without one has null.
    """
    nth = F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(place))
    mine = headings.withColumn("_t", plain_title(title)).withColumn("_n", nth)
    bears = paragraphs.select(*keys, F.col(paragraph).alias("start"), plain_title(text).alias("_t")).where("_t <> ''")
    bears = bears.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_t").orderBy("start")))
    return mine.join(bears, [*keys, "_t", "_n"], "left").drop("_t", "_n")


def sections_of(places: DataFrame, headings: DataFrame, keys: Sequence[str], at: str, start: str, value: str) -> DataFrame:
    """Places with the ``section`` that holds them: ``value`` of the last heading that starts at or before them.

    Both are sorted together by place, so no pair of a place and a heading is made.
    """
    events = headings.where(F.col(start).isNotNull()).select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(value).alias("v")).alias("_v"), F.lit(None).cast(places.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    rows = places.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(events.schema["_v"].dataType).alias("_v"), F.struct("*").alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = events.unionByName(rows).withColumn("_s", F.last("_v", ignorenulls=True).over(w))
    return met.where("_kind = 1").select("_row.*", F.col("_s.v").alias("section"))
