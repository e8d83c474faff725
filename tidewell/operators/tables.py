"""Table operators: upsert, lookup, delete, counts, archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: URL namespace of version-5 identifiers (fixed value of RFC 4122).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows, or an error when they are computed if two of them have one key."""
    twice = F.concat(F.lit(f"two rows have one {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return counted.where(F.when(F.col("_n") > 1, F.raise_error(twice).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def upsert(base: DataFrame, updates: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows of ``updates`` replace rows of ``base`` with the same key; of several, the first in order stays.

    Without an order two updates of one key are an error, since nothing says which is
    the last.
    """
    new = latest(updates, [key], *order) if order else unique(updates, key)
    return base.join(new.select(key), key, "left_anti").unionByName(new.select(*base.columns))


def name_uuid(name: Column) -> Column:
    """Version-5 identifier of a name in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def row_id(doc: Column, index: Column, content: Column) -> Column:
    """Deterministic id of a document's row."""
    return name_uuid(F.concat_ws(":", doc.cast("string"), index.cast("string"), content))


def fetch_first(rows: DataFrame, field: str, value: object, *order: str) -> DataFrame:
    """The first row with a field's value."""
    return rows.where(F.col(field) == F.lit(value)).orderBy(*order).limit(1)


def fetch_all(rows: DataFrame, field: str, value: object, *order: str, limit: int = 500) -> DataFrame:
    """At most ``limit`` rows with a field's value, in order."""
    return rows.where(F.col(field) == F.lit(value)).orderBy(*order).limit(limit)


def delete_where(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key isn't among ``keys``."""
    return rows.join(keys, on, "left_anti")


def of_space(rows: DataFrame, model: str, column: str = "embed_model") -> DataFrame:
    """Rows embedded in the expected space; blank models don't match."""
    return rows.where((F.trim(F.col(column)) != "") & (F.col(column) == F.lit(model)))


def archive(log: DataFrame, key: str, at: str, overwrite: Sequence[str], keep: Sequence[str], tie: str) -> DataFrame:
    """One row per key: last values of ``overwrite``, last known values of ``keep``, first and last time."""
    order = F.struct(at, tie)
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in keep]
    return log.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in overwrite], *known, F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def reusable(archived: DataFrame, rejected: Sequence[str], min_trust: float, limit: int, key: str) -> DataFrame:
    """Archived rows worth another use, most trusted first, unknown trust last."""
    ok = ~F.col("status").isin(*rejected) & (F.col("trust").isNull() | (F.col("trust") >= min_trust))
    return archived.where(ok).orderBy(F.col("trust").desc_nulls_last(), F.col("last_seen").desc(), key).limit(limit)


def first_wins(rows: DataFrame, key: Column | str, *order: Column | str) -> DataFrame:
    """The first row of each key in order; rows without key are dropped."""
    key = F.col(key) if isinstance(key, str) else key
    keyed = rows.withColumn("_key", key).where(F.col("_key").isNotNull() & (F.col("_key") != F.lit("")))
    return latest(keyed, ["_key"], *[F.col(c) if isinstance(c, str) else c for c in order]).drop("_key")


def bold_links(rows: DataFrame, key: str, text: str, allowed: DataFrame, url: str) -> DataFrame:
    """Texts whose Markdown links to addresses that aren't among ``allowed`` are bold text instead; ``key`` is unique.

    Texts are cut at their links, the links' addresses meet the list by equality.
    """
    link = r"\[([^\]]+)\]\(([^)]+)\)"
    marked = F.split(F.regexp_replace(F.col(text), r"(\[[^\]]+\]\([^)]+\))", "\u0001$1\u0001"), "\u0001")
    parts = rows.select(key, F.posexplode(marked).alias("_i", "_part"))
    parts = parts.withColumn("_url", F.when(F.col("_part").rlike("^" + link + "$"), F.regexp_extract("_part", "^" + link + "$", 2)))
    known = allowed.select(F.col(url).alias("_url")).where("_url IS NOT NULL").distinct().withColumn("_ok", F.lit(True))
    judged = parts.join(known, "_url", "left")
    bold = F.concat(F.lit("**"), F.regexp_extract("_part", "^" + link + "$", 1), F.lit("**"))
    body = F.when(F.col("_url").isNotNull() & F.col("_ok").isNull(), bold).otherwise(F.col("_part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", body.alias("t")))), lambda x: x["t"]), "")
    return rows.drop(text).join(judged.groupBy(key).agg(joined.alias(text)), key)


def count_by(rows: DataFrame, field: str) -> DataFrame:
    """Rows for each value of a field."""
    return rows.groupBy(field).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(rows: DataFrame, field: str) -> DataFrame:
    """Known, non-blank values of a field."""
    return rows.select(field).where(F.col(field).isNotNull() & (F.trim(F.col(field)) != "")).distinct()
