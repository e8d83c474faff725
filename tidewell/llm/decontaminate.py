"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows are normalised and kept as a set.  A bit filter with
two probes, sized from the number of windows, is part of the scan's expression:
each document is read once, its windows are hashed in place, and only positions
that pass the filter leave the scan, with the window's words.  They are then
verified by an equality join with the windows themselves, broadcast while their
number and their bytes are under stated bounds and shuffled beyond them.  A hit carries
its window's number; the items that hold a window are joined to each document's distinct
windows afterwards, one row an item.  Where items shorter than a
window make windows of several sizes, one pass over the positions looks for the
beginnings of all windows, as long as the shortest, and the sizes are told apart
only where that passes.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lowered.
An item of fewer words than a window is one window of its own length.

The filter lets a share of the other positions through: a hundredth at 16 bits a
window, which holds up to ``MOST_CHARS * 6 / 16`` windows (6 million); beyond that the
share grows and with it what the join is given, never what it finds.

Defined results: null and empty texts have no words, no hits and the digest of the
empty string; texts and words of any length are read whole; items without id or words match nothing; windows that several items
share count for all of them; rows that repeat an id are documents of their own; an
empty benchmark leaves every document clean; columns beyond id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, with_row_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Six bits of the filter to a byte, so that every byte is an ASCII letter: bits for each window, least and most bytes.
BITS_EACH = 16
LEAST_CHARS, MOST_CHARS = 1 << 17, 1 << 24
#: Bytes of the filter that one row holds while it is made.
CHUNK = 1 << 12
#: Most windows that are broadcast, and most bytes of what is broadcast: of windows' words, of items' ids.
BROADCAST_WINDOWS = 500_000
BROADCAST_BYTES = 1 << 26
#: Bytes that a broadcast row takes beside its string.
ROW_BYTES = 48
#: Most document keys that are broadcast when documents are dropped; 16 bytes each.
BROADCAST_KEYS = 1_000_000


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, size, window, h``: every window of every item, by the item's id as a string; one more often in an item is not repeated."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    sized = items.select("item", "w", F.least(F.size("w"), F.lit(width)).alias("size"))
    each = sized.select("item", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda i: F.slice("w", i, F.col("size")))).alias("part"))
    return each.select("item", "size", F.array_join("part", " ").alias("window"), F.xxhash64("part").alias("h")).distinct()


def _small(rows: DataFrame, text: str) -> bool:
    """Whether a computed table is within both bounds of a broadcast."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text) + ROW_BYTES), F.lit(0))).first()
    return n <= BROADCAST_WINDOWS and size <= BROADCAST_BYTES


class WindowFilter:
    """A bit filter of hashes as a literal of the scan's expression."""

    def __init__(self, hashes: DataFrame, n: int) -> None:
        """``hashes(h)``, ``n`` of them."""
        self.chars = min(MOST_CHARS, max(LEAST_CHARS, -(-n * BITS_EACH // (6 * CHUNK)) * CHUNK))
        slots = hashes.select(F.explode(F.array(*map(self._slot, self._probes(F.col("h"))))).alias("slot"))
        bits = slots.groupBy(F.floor(F.col("slot") / 6).alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(slot % 6 AS int)))").alias("bits"))
        placed = bits.groupBy(F.floor(F.col("at") / CHUNK).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct((F.col("at") % CHUNK).cast("int").alias("place"), "bits"))).alias("set"))
        shown = placed.select("chunk", F.expr(f"rpad(aggregate(set, '', (s, x) -> rpad(s, x.place, '@') || char(64 + x.bits)), {CHUNK}, '@')").alias("text"))
        made = [b"@" * CHUNK] * (self.chars // CHUNK)
        for row in shown.collect():  # at most MOST_CHARS bytes
            made[row["chunk"]] = row["text"].encode()
        self.table = F.lit(b"".join(made))

    @staticmethod
    def _probes(h: Column) -> tuple[Column, Column]:
        return h, F.xxhash64(h)

    def _slot(self, h: Column) -> Column:
        return F.pmod(h, F.lit(6 * self.chars))

    def passes(self, h: Column) -> Column:
        def set_at(slot: Column) -> Column:
            byte = F.ascii(F.substring(self.table, F.floor(slot / 6).cast("int") + 1, F.lit(1)).cast("string"))
            return F.getbit(byte, (slot % 6).cast("int")) == 1

        first, second = self._probes(h)
        return set_at(self._slot(first)) & set_at(self._slot(second))


def numbered_windows(windows: DataFrame) -> DataFrame:
    """``size, window, h, wid``: distinct windows, numbered, computed once."""
    return cut(windows.select("size", "window", "h").distinct().withColumn("wid", F.monotonically_increasing_id()))


def scan_windows(docs: DataFrame, held: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its verified hits of numbered windows: ``_row, doc_id, text_key, n_words, pos, size, wid``, nulls where it has none."""
    counted = {r["size"]: r["n"] for r in held.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the window's width
    sizes, n_windows = sorted(counted), sum(counted.values())
    source = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")))
    split = source.select("_row", "doc_id", F.xxhash64("_text").alias("text_key"), words_of(F.col("_text")).alias("w")).withColumn("n_words", F.size("w"))
    if len(sizes) > 1:  # places where a window of any size may begin
        least = sizes[0]
        beginnings = held.select(F.xxhash64(F.slice(F.split("window", " "), 1, least)).alias("h")).distinct()
        begins = WindowFilter(beginnings, n_windows)
        places = F.filter(F.sequence(F.lit(1), F.col("n_words") - least + 1), lambda i: begins.passes(F.xxhash64(F.slice("w", i, least))))
        split = split.withColumn("places", F.when(F.col("n_words") >= least, places))
    whole = WindowFilter(held.select("h"), n_windows)

    def found(size: int) -> Column:
        passes = lambda i: whole.passes(F.xxhash64(F.slice("w", i, size)))
        if len(sizes) > 1:
            places = F.filter("places", lambda i: (i <= F.col("n_words") - size + 1) & passes(i))
        else:
            places = F.filter(F.sequence(F.lit(1), F.col("n_words") - size + 1), passes)
        hits = F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), F.array_join(F.slice("w", i, size), " ").alias("window")))
        return F.when(F.col("n_words") >= size, hits)

    none = F.expr("cast(array() AS array<struct<pos:int,size:int,window:string>>)")
    all_hits = F.concat(*[F.coalesce(found(s), none) for s in sizes]) if sizes else none
    scanned = split.select("_row", "doc_id", "text_key", "n_words", F.explode_outer(all_hits).alias("c"))
    scanned = scanned.select("_row", "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.col("c.pos").alias("pos"), F.col("c.size").alias("size"), F.coalesce("c.window", F.concat(F.lit(" "), F.col("_row"))).alias("window"))
    right = held.select("window", "wid")
    right = F.broadcast(right) if _small(held, "window") else right
    # a document without hits meets no window, as none begins with a space; sizes agree because words do
    return scanned.join(right, "window", "left").drop("window")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, hit words, items and verdict of every row of ``docs``; ``spans`` are the hit words' ranges from 0."""
    windows = benchmark_windows(benchmark, width)
    held = numbered_windows(windows)
    holders = cut(windows.join(held.select("window", "wid"), "window").select("wid", "item"))
    scanned = scan_windows(docs, held, id_col, text_col)
    document = ["_row", "doc_id", "text_key", "n_words"]
    hit = F.when(F.col("wid").isNotNull(), F.struct("pos", "size"))
    grouped = scanned.groupBy(*document).agg(F.collect_set(hit).alias("hits"), F.collect_set("wid").alias("wids"))
    start = F.expr("cast(array() AS array<struct<first:int,last:int>>)")

    def join_spans(spans: Column, x: Column) -> Column:
        first, last = x["pos"] - 1, x["pos"] + x["size"] - 2
        previous = F.try_element_at(spans, F.lit(-1))
        joined = F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(F.struct(previous["first"].alias("first"), F.greatest(previous["last"], last).alias("last"))))
        return F.when((F.size(spans) > 0) & (first <= previous["last"] + 1), joined).otherwise(F.concat(spans, F.array(F.struct(first.alias("first"), last.alias("last")))))

    spans = F.aggregate(F.array_sort("hits"), start, join_spans)
    met = grouped.withColumn("spans", spans).select(*document, "spans", F.posexplode_outer("wids").alias("_i", "wid"))
    met = met.withColumn("spans", F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("spans")))  # once, not with each window
    named = met.join(F.broadcast(holders) if _small(holders, "item") else holders, "wid", "left")
    shown = named.groupBy(*document).agg(F.first("spans", ignorenulls=True).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return shown.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without a hit.

    Hit rows are told by id and text; their keys are broadcast while they are few.
    """
    scanned = scan_windows(docs, numbered_windows(benchmark_windows(benchmark, width)), id_col, text_col)
    keys = cut(scanned.where("wid IS NOT NULL").select(F.col("doc_id").alias("__hit_id"), F.col("text_key").alias("__hit_text")).distinct())
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(keys, (F.col(id_col).cast("long").eqNullSafe(F.col("__hit_id"))) & (F.xxhash64(F.col(text_col)) == F.col("__hit_text")), "left_anti")
