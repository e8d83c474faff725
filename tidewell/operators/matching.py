"""Joins by containment and allocation of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.urls import strip_slash
from tidewell.operators.dedup import cut


def _runs(text: str, size: Column) -> Column:
    """All runs of so many characters of a text, each once."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, size)))


def _held_in(needles: DataFrame, hay: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """``keys, _n, _h``: distinct texts ``_n`` that lie in texts ``_h`` of the same keys.

    Each needle is looked for by the one of its runs that fewest hay texts hold, so a
    beginning that many texts share meets nothing by itself.
    """
    sized = needles.withColumn("_size", F.least(F.length("_n"), F.lit(width)))
    sizes = sorted(r._size for r in sized.select("_size").distinct().collect())  # at most `width` values
    asked = cut(sized.select(*keys, "_n", F.explode(_runs("_n", F.col("_size"))).alias("_run")))
    long_enough = lambda k: F.when(F.length("_h") >= k, _runs("_h", F.lit(k))).otherwise(F.expr("cast(array() AS array<string>)"))
    runs = F.concat(*[long_enough(k) for k in sizes]) if sizes else F.expr("cast(array() AS array<string>)")
    wanted = asked.select(*keys, "_run").distinct()
    held = cut(hay.select(*keys, "_h", F.explode(runs).alias("_run")).join(wanted, [*keys, "_run"], "left_semi"))
    often = held.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_df"))
    counted = asked.join(often, [*keys, "_run"], "left")
    rarest = counted.groupBy(*keys, "_n").agg(F.count_if(F.col("_df").isNull()).alias("_absent"), F.min_by("_run", F.struct("_df", "_run")).alias("_run"))
    met = rarest.where("_absent = 0").select(*keys, "_n", "_run").join(held, [*keys, "_run"])
    return met.where(F.contains("_h", "_n")).select(*keys, "_n", "_h")


def containment_within(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, place: str) -> DataFrame:
    """Each distinct text of ``left`` with the sorted distinct places of the texts of ``right``, of equal keys, that equal or hold it or lie in it.

    A key is one document, whose texts are compared side by side as two lists; only what
    is met leaves them.  Blank texts match nothing.  For tables without such a key there
    is ``containment``.
    """
    lefts = left.where(F.length(F.trim(a)) > 0).groupBy(*keys).agg(F.collect_set(a).alias("_l"))
    rights = right.where(F.length(F.trim(b)) > 0).groupBy(*keys).agg(F.collect_list(F.struct(F.col(b).alias("t"), F.col(place).alias("p"))).alias("_r"))
    held = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter("_r", lambda r: F.contains(r["t"], c) | F.contains(c, r["t"])), lambda r: r["p"])))
    met = lefts.join(rights, list(keys)).select(*keys, F.explode(F.transform("_l", lambda c: F.struct(c.alias("c"), held(c).alias("p")))).alias("m"))
    return met.where(F.size("m.p") > 0).select(*keys, F.col("m.c").alias(a), F.col("m.p").alias(place))


def containment(left: DataFrame, right: DataFrame, a: str, b: str, keys: Sequence[str] = (), width: int = 8) -> DataFrame:
    """Pairs, within equal ``keys``, where one text equals or holds the other; blank texts match nothing.

    Whole texts take part.  Equal texts are matched once and joined to their rows after.
    Pairs meet by equality of a run of at most ``width`` characters and are then checked
    in full.
    """
    lefts, rights = left.where(F.length(F.trim(a)) > 0), right.where(F.length(F.trim(b)) > 0)
    x, y = lefts.select(*keys, F.col(a).alias("_a")).distinct(), rights.select(*keys, F.col(b).alias("_b")).distinct()
    inside = _held_in(x.withColumnRenamed("_a", "_n"), y.withColumnRenamed("_b", "_h"), keys, width).select(*keys, F.col("_n").alias("_a"), F.col("_h").alias("_b"))
    around = _held_in(y.withColumnRenamed("_b", "_n"), x.withColumnRenamed("_a", "_h"), keys, width).select(*keys, F.col("_h").alias("_a"), F.col("_n").alias("_b"))
    pairs = inside.union(around).distinct()
    found = lefts.withColumn("_a", F.col(a)).join(pairs, [*keys, "_a"])
    return found.join(rights.withColumn("_b", F.col(b)), [*keys, "_b"]).drop("_a", "_b")


def number_rows(rows: DataFrame, position: str, name: str) -> DataFrame:
    """Number rows from 1 in order of position.

    Rows are dealt to ranges once and kept in the shared folder, with their place in
    their range; the ranges' sizes then give every range's first number.  Rows of equal
    position are numbered in some order.
    """
    kept = cut(rows.repartitionByRange(position).sortWithinPartitions(position).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ahead = sizes.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_ahead"))
    numbered = kept.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return numbered.withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_ahead") + 1).drop("_part", "_at", "_ahead")


def allocate_ids(registry: DataFrame, rows: DataFrame, key: str, id_col: str, position: str) -> DataFrame:
    """Rows with the id of their key: the registry's, or the next free one in order of first position.

    Rows that share a new key share its id; rows with a null or blank key get one each.
    Distinct new keys are numbered by ranges rather than in one task.
    """
    known = registry.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").groupBy(key).agg(F.min(id_col).alias(id_col))
    found = cut(rows.join(known, key, "left"))
    blank = F.trim(F.coalesce(F.col(key), F.lit(""))) == ""
    fresh = found.where(F.col(id_col).isNull()).drop(id_col).withColumn("_own", F.when(blank, F.concat(F.lit("\0"), F.col(position))).otherwise(F.col(key)))
    numbered = number_rows(fresh.groupBy("_own").agg(F.min(position).alias("_first")), "_first", "_n")
    top = registry.agg(F.max(id_col).alias("_top"))
    ids = numbered.crossJoin(F.broadcast(top)).select("_own", (F.coalesce("_top", F.lit(0)) + F.col("_n")).alias(id_col))  # one row
    return found.where(F.col(id_col).isNotNull()).unionByName(fresh.join(ids, "_own").drop("_own"))


def patch_registry(registry: DataFrame, rows: DataFrame, mapped: DataFrame, keys: Sequence[str], url: str, id_col: str, position: str, cap: int = 32) -> tuple[DataFrame, DataFrame]:
    """Ids of new rows by URL, and the registries with them.

    Each value of ``keys`` has a registry of its own, bounded by ``cap``.  A URL that the
    registry knows, without regard to case and slashes at the end, keeps its id, of
    several the last one's; a new URL takes the next number past the registry's length
    that isn't used, once for all its rows; a blank URL is new each time.  Beyond the cap
    an entry stays if ``mapped`` (``keys``, id) names it; the others stay in order while
    there is room.
    """
    key = F.coalesce(strip_slash(url), F.lit(""))
    old = registry.select(*keys, F.col(position).alias("_at"), F.col(id_col).alias("_id"), key.alias("_k"))
    new = rows.select(*keys, F.col(position).alias("_at"), key.alias("_k"))
    known = old.where("_k <> ''").groupBy(*keys, "_k").agg(F.max_by("_id", "_at").alias("_id"))
    found = new.join(known, [*keys, "_k"], "left").withColumn("_own", F.when(F.col("_k") == "", F.concat(F.lit("\0"), F.col("_at"))).otherwise(F.col("_k")))
    held = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set("_id")).alias("_used"))
    firsts = found.where("_id IS NULL").groupBy(*keys, "_own").agg(F.min("_at").alias("_first"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))
    length = F.coalesce("_n", F.lit(0))
    used = F.filter(F.coalesce("_used", F.expr("cast(array() AS array<bigint>)")), lambda u: u > length)
    free = F.aggregate(used, (length + F.col("_nth")).cast("long"), lambda at, u: at + F.when(u <= at, 1).otherwise(0).cast("long"))
    made = firsts.withColumn("_nth", nth).join(held, list(keys), "left").select(*keys, "_own", "_first", free.alias("_new"))
    ids = found.join(made.drop("_first"), [*keys, "_own"], "left").select(*keys, F.col("_at").alias(position), F.coalesce("_id", "_new").alias(id_col))
    whole = old.select(*keys, "_id", F.lit(0).alias("_part"), "_at").unionByName(made.select(*keys, F.col("_new").alias("_id"), F.lit(1).alias("_part"), F.col("_first").alias("_at")))
    pins = mapped.select(*keys, F.col(id_col).alias("_id")).distinct().withColumn("_pin", F.lit(True))
    marked = whole.join(pins, [*keys, "_id"], "left").withColumn("_pin", F.coalesce("_pin", F.lit(False)))
    group = Window.partitionBy(*keys)
    ordered = marked.withColumn("_all", F.count(F.lit(1)).over(group)).withColumn("_pins", F.count_if("_pin").over(group))
    ordered = ordered.withColumn("_rest", F.row_number().over(Window.partitionBy(*keys, "_pin").orderBy("_part", "_at")))
    stays = (F.col("_all") <= cap) | F.col("_pin") | (F.col("_rest") <= cap - F.col("_pins"))
    first = F.when((F.col("_all") > cap) & ~F.col("_pin"), 1).otherwise(0)  # a cut registry lists its pinned entries first
    place = F.row_number().over(group.orderBy(first, "_part", "_at")).cast("long")
    return ids, ordered.where(stays).select(*keys, place.alias("place"), F.col("_id").alias(id_col))
