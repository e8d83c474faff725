"""Similarity join on word shingles with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their shingle sets reaches the
threshold.  Shingles have one global order, rare ones first.  In that order, a
linked pair shares at least L shingles within the first ``n - ceil(t n) + L`` of
each, for every L; so a document may lengthen its prefix by one shingle and
require one more match.  Each document picks the L of least estimated cost: the
postings that its prefix meets, plus the verifications left when a candidate needs
L of them.  A pair is verified when it shares as many prefix shingles as the
smaller L of the two.

1. A counter sketch of fixed size, summed over all documents, tells common
   shingles from rare ones; it sets the order and the cost estimate.
2. Every document yields its set's fingerprint, size, L and prefix.  Equal sets
   become one node at once.
3. Star rounds: for each shared prefix shingle a few central documents, one for
   each salt, are compared with the others.  Their verified links already join
   most of a large group of near copies.
4. Exact round: all pairs that share enough prefix shingles and still lie in
   different components are verified.  Within a component no further pair can
   change the result, so a group of copies is never expanded into its pairs.  At
   shingles of many documents, a pair leaves the join only if the parity bits of
   both sets allow the threshold: sets differ in at least as many shingles as
   their bits differ, so this drops no link.

Nothing is capped: the star rounds only save work, the exact round decides.  The
documents of a frequent shingle are dealt by the size of their sets, then into cells,
before they meet; a class of d documents moves about ``2 d * d / CELL`` rows, which is
quadratic with a small factor; joins in which
a shingle, fingerprint or label only meets its own row are linear, and adaptive
execution splits their large partitions.

Shingles are 64-bit hashes and equal sets are told by 128-bit fingerprints, so the
result is exact unless hashes collide: two given shingles do with probability
2**-64, two given sets with 2**-128.

Defined results: a null or empty text, or one without words, has an empty set and
links with nothing; a row without id takes the component of its equal or stays
without one; rows that repeat an id are one document as far as links
go, and each keeps its own number of shingles (``keep_one_per_group`` keeps them all
or none); texts and words of any length are read whole; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, forget, pack_counters, sum_counters, text_batches, with_row_key
from tidewell.llm.components import components
from tidewell.llm.shingles import WordHashes, fingerprint, shingle_sets

#: Counters of the sketch: 2**22 of 4 bytes, whatever the corpus.
SKETCH_BITS = 22
SLICE = 1 << 15
#: Cost of one verification in postings.
VERIFY_COST = 20.0
MAX_MATCHES = 4
#: Central documents of a shingle in a star round.
SALTS = 8
#: Parity bits of a set, in 64-bit words; compared at shingles of more documents than this.
PARITY_WORDS, FEW = 16, 16
#: Documents of a shingle in one cell of the exact round.
CELL = 4096
#: Bits of the filter by which texts of candidates are found again.
FILTER_BITS = 24


PARITY = [f"parity_{k:02d}_" for k in range(PARITY_WORDS)]


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How many documents hold a shingle, by counter; never too low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, counters, mask = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int32), np.uint64((1 << SKETCH_BITS) - 1)
        for whole in batches:
            for _, texts in text_batches(whole, "text"):
                found = shingle_sets(texts, held, width)
                for s in found:  # distinct shingles, but two may share a counter
                    at, n = np.unique(s & mask, return_counts=True)
                    counters[at] += n.astype(np.int32)
        got = list(pack_counters(counters, SLICE))
        for k in range(0, len(got), 16):
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got[k : k + 16]], pa.int32()), pa.array([p for _, p in got[k : k + 16]], pa.binary())], ["slice", "payload"])

    return sum_counters(docs.select("text").mapInArrow(run, "slice int, payload binary"), 1 << SKETCH_BITS, SLICE, "int32")


def pick_prefix(shingles: np.ndarray, counters: np.ndarray, noise: float, heavy: float, percent: int) -> tuple[int, np.ndarray]:
    """The number of matches to require and the prefix for it."""
    n = len(shingles)
    need = -(-percent * n // 100)
    counts = counters[(shingles & np.uint64(len(counters) - 1)).astype(np.int64)]
    rank = np.where(counts > heavy, counts, 0)  # below the sketch's noise the hash alone orders
    longest = min(n, n - need + min(MAX_MATCHES, need))
    order = np.lexsort((shingles, rank))[:longest]
    met = np.cumsum(np.maximum(counts[order] - noise, 1.0))
    best = min(range(1, min(MAX_MATCHES, need) + 1), key=lambda m: met[n - need + m - 1] * (1 + VERIFY_COST / m))
    return best, shingles[order[: n - need + best]]


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether each of the slots holds an odd number of the set's shingles, as 64-bit words."""
    slots = ((shingles >> np.uint64(24)) & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=64 * PARITY_WORDS).astype(np.uint8) & 1).view(np.int64)


def prefixes(docs: DataFrame, counters: np.ndarray, width: int, percent: int) -> DataFrame:
    """``doc_id, n, fp1, fp2, matches, prefix`` and parity words of every row."""
    noise = float(np.median(counters))
    heavy = noise + 8 * max(1.0, noise**0.5) + 8
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = WordHashes()
        for whole in batches:
            for batch, texts in text_batches(whole, "text"):
                rows, found = [], shingle_sets(texts, held, width)
                words = np.array([parity(s) for s in found]).T
                for s in found:
                    best, prefix = pick_prefix(s, shared.value, noise, heavy, percent) if len(s) else (0, s)
                    rows.append((len(s), *fingerprint(s), best, prefix.view(np.int64)))
                n, fp1, fp2, best, prefix = zip(*rows)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate(prefix), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(best, pa.int32()), lists, *map(pa.array, words)], ["doc_id", "n", "fp1", "fp2", "matches", "prefix", *PARITY])

    made = cut(docs.mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, matches int, prefix array<long>, " + ", ".join(f"{p} long" for p in PARITY)))
    shared.unpersist()
    return made


def candidate_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of the given nodes, made from their texts again.

    A bit filter of fixed size passes the nodes' rows and a few others, so texts are
    read but not shuffled; the join then keeps the nodes alone.
    """
    words = 1 << (FILTER_BITS - 6)
    bits = nodes.select(F.xxhash64("node").alias("h")).select(
        F.pmod(F.shiftrightunsigned("h", 6), F.lit(words)).cast("int").alias("word"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit")
    )
    table = np.zeros(words, np.int64)
    for row in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # at most 2**18 rows
        table[row.word] = row.bits
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = WordHashes()
        for whole in batches:
            h = whole.column("h").to_numpy().view(np.uint64)
            hit = (shared.value[((h >> np.uint64(6)) % np.uint64(words)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)
            for batch, texts in text_batches(whole.filter(pa.array(hit.astype(bool))), "text"):
                found = [s.tobytes() for s in shingle_sets(texts, held, width)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["node", "shingles"])

    made = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "node long, shingles binary")
    found = cut(made.join(nodes, "node", "left_semi"))
    shared.unpersist()  # a stage that adaptive execution no longer waits for may still ask for it
    return found


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the threshold; without pairs no text is read."""
    if not pairs.limit(1).count():
        return pairs
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = candidate_sets(docs, nodes, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                same = int((y[at] == x).sum()) if len(y) else 0
                good.append(bool(same) and 100 * same >= percent * (len(x) + len(y) - same))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _may_link(percent: int) -> F.Column:
    """Sizes that allow the threshold."""
    return (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (F.col("node") != F.col("node2"))


def _bits_may_link(percent: int) -> F.Column:
    """Parity bits that allow the threshold; the symmetric difference is at least the bits' distance."""
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}2"))) for p in PARITY[1:]), F.bit_count(F.col(PARITY[0]).bitwiseXOR(F.col(f"{PARITY[0]}2"))))
    return (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n2"))


def _other(postings: DataFrame) -> DataFrame:
    return postings.select("token", *[F.col(c).alias(f"{c}2") for c in postings.columns if c != "token"])


def _met(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"), F.least("matches", "matches2").alias("need"), "token")


def _pairs(met: DataFrame) -> DataFrame:
    """Pairs that share enough prefix shingles, each once."""
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.min("need").alias("need")).where("met >= need").select("a", "b")


def _labelled(postings: DataFrame, found: DataFrame | None) -> DataFrame:
    """Postings with the component of their node so far."""
    if found is None:
        return postings.withColumn("comp", F.col("node"))
    return postings.join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def _undecided(postings: DataFrame) -> DataFrame:
    """Postings of shingles that lie in two components at least."""
    split = postings.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("df")).where("lo <> hi").select("token", "df")
    return postings.join(split, "token")


def _cells(many: DataFrame, percent: int) -> DataFrame:
    """Rows of shingles of many documents with those that they may link with.

    The threshold bounds the ratio of two sets' sizes, so a document meets those of its
    own class of sizes and of the next.  Within a class the documents of a shingle are
    dealt into cells of some ``CELL`` rows, and each cell meets all that its class has
    to meet, so no task holds a whole shingle.
    """
    width = math.log(100 / percent) * (1 + 1e-9) + 1e-9
    sized = many.withColumn("sizes", F.floor(F.log("n") / width).cast("int"))
    cells = cut(sized.groupBy("token", "sizes").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells")))
    mine = sized.join(cells, ["token", "sizes"]).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).drop("cells")
    others = _other(sized.withColumn("own", F.col("sizes"))).withColumnRenamed("sizes2", "sizes")
    others = others.withColumn("sizes", F.explode(F.array("sizes", F.col("sizes") - 1))).join(cells, ["token", "sizes"])
    others = others.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    once = (F.col("own2") > F.col("sizes")) | (F.col("node") < F.col("node2"))
    return mine.join(others, ["token", "sizes", "cell"]).where(once)


def link_components(docs: DataFrame, width: int = 3, percent: int = 90, star_rounds: int = 1) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``."""
    rows = with_row_key(prefixes(docs, sketch(docs, width), width, percent))
    equal = cut(rows.where("n > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.min_by("_row", "doc_id").alias("_row")))
    nodes = rows.join(equal.where("node IS NOT NULL").select("_row"), "_row", "left_semi").select(F.col("doc_id").alias("node"), "n", "matches", "prefix", *PARITY)
    postings = nodes.select("node", "n", "matches", F.explode("prefix").alias("token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token")
    postings = cut(postings.join(shared, "token", "left_semi"))
    central = postings.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))  # few edits leave many shared shingles
    ranked = cut(postings.join(central, "node"))

    links = found = tried = None
    open_ = _undecided(_labelled(ranked, found))
    for turn in range(star_rounds):
        salt = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(SALTS)).alias("salt")
        leads = open_.groupBy("token", salt).agg(F.max(F.struct("shared", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "matches", "comp")).alias("lead"))
        leads = leads.select("token", F.col("lead.node").alias("node2"), F.col("lead.n").alias("n2"), F.col("lead.matches").alias("matches2"), F.col("lead.comp").alias("comp2"))
        pairs = _pairs(_met(open_.join(leads, "token").where(_may_link(percent) & (F.col("comp") != F.col("comp2")))).distinct())
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        got = cut(verified(pairs, docs, width, percent))
        if not got.limit(1).count():
            break
        links = got if links is None else links.union(got)
        found = components(links)
        open_ = _undecided(_labelled(ranked, found))

    open_ = cut(open_.drop("shared"))
    apart = _may_link(percent) & (F.col("comp") != F.col("comp2"))
    few, many = open_.where(F.col("df") <= FEW), open_.where(F.col("df") > FEW)
    many = cut(many.join(nodes.select("node", "n", *PARITY), ["node", "n"]))  # read three times
    met_few = _met(few.join(_other(few), "token").where(apart & (F.col("node") < F.col("node2"))))
    met_many = _met(_cells(many, percent).where(apart & _bits_may_link(percent)))
    pairs = _pairs(met_few.union(met_many))
    pairs = cut(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs)
    last = cut(verified(pairs, docs, width, percent))
    if last.limit(1).count():
        found = components(last if links is None else links.union(last))
    equal = equal.drop("_row")
    groups = equal if found is None else equal.join(found, "node", "left")
    groups = groups.select("fp1", "fp2", (F.col("node") if found is None else F.coalesce("component", "node")).alias("component_id"))
    joined = rows.where("n > 0").select("doc_id", "n", "fp1", "fp2").join(groups, ["fp1", "fp2"])
    linked = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id")))


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; rows without id stay."""
    found = link_components(documents_of(docs, id_col, text_col), width, percent)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(drop, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
