"""Best-fit packing of documents into fixed-length token sequences.

Best-fit decreasing over all documents at once.  Piece lengths are integers
from 1 to the capacity, so the whole packing is decided from one histogram of
lengths: bins of equal remaining capacity are kept as runs, a segment tree
over the remaining capacities finds the tightest open one in logarithmic time,
and equal pieces are placed run by run.  The driver's work and the broadcast
plan depend on the capacity only, never on the number of documents; pieces
find their place by their rank among pieces of equal length.

Defined results: a null or empty text is one piece that holds the end id
alone; a text of any length is encoded whole and cut into pieces of the capacity; a
row without id is packed under a null id; rows that repeat an id are packed as rows
of their own; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, text_batches
from tidewell.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


class CapacityTree:
    """Segment tree of the open bins' number for each remaining capacity."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.width
        while i:
            self.open[i] += n
            i //= 2

    def tightest(self, length: int) -> int:
        """The smallest remaining capacity of at least ``length`` that has an open bin, or -1."""
        i = length + self.width
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return -1


def plan_best_fit(histogram: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing of ``histogram[length]`` pieces of each length.

    Each row of the plan places the pieces of one length with ranks from
    ``first``: ``each`` of them go to one bin, bins from ``bin`` on, at offset
    ``base``.  Rows are sorted by length and rank.
    """
    tree, runs = CapacityTree(capacity), {}
    rows: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def leave(left: int, start: int, n: int) -> None:
        if n and left:
            runs.setdefault(left, []).append((start, n))
            tree.add(left, n)

    for length in range(capacity, 0, -1):
        todo, rank = int(histogram[length]), 0
        while todo:
            left = tree.tightest(length)
            if left < 0:
                left, each = capacity, capacity // length
                start, n = bins, -(-todo // each)
                bins += n
            else:
                each = left // length
                start, n = runs[left].pop()
                tree.add(left, -n)
            placed = min(todo, n * each)
            rows.append((length, rank, start, each, capacity - left))
            full, rest = divmod(placed, each)
            leave(left - each * length, start, full)
            if rest:
                leave(left - rest * length, start + full, 1)
            leave(left, start + full + bool(rest), n - full - bool(rest))
            rank += placed
            todo -= placed
    rows.sort()
    names = ("length", "first", "bin", "each", "base")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids, with the crc32 of their ids and their number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch, texts in text_batches(whole, "text"):
                out: list[list] = [[], [], [], [], [], [], []]
                for doc, ids in zip(batch.column("doc_id").to_pylist(), code.encode(texts)):
                    ids += end
                    for k in range(0, len(ids), width):
                        piece = ids[k : k + width]
                        n = len(piece) // 4
                        for column, x in zip(out, (doc, k // width, k // 4, n, zlib.crc32(piece), int(seen[n]), piece)):
                            column.append(x)
                        seen[n] += 1
                fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
                arrays = [pa.array(x, t) for x, (_, t) in zip(out, fields)] + [pa.array([part] * len(out[0]), pa.int32()), pa.array(out[5], pa.int64())]
                names = [n for n, _ in fields] + ["part", "nth"]
                if with_ids:
                    arrays.append(pa.array(out[6], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have ``length``, ``part`` and ``nth``.

    ``nth`` numbers the pieces of one length within ``part`` from 0.  The rank among
    all pieces of a length is ``nth`` plus what earlier parts hold: one row per part
    and length is summed before anything is dealt out, so a length that a third of
    all pieces share costs no more than any other.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[row.length] = row.n
    plan = spark.sparkContext.broadcast(plan_best_fit(histogram, capacity))
    ranked = pieces.join(offsets.drop("n"), ["length", "part"]).withColumn("rank", F.col("nth") + F.col("ahead")).drop("part", "nth", "ahead")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long, offset long"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        keys = (p["length"] << 48) + p["first"]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            n = rank - p["first"][at]
            each = p["each"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p["bin"][at] + n // each), pa.array(p["base"][at] + n % each * length)], [*batch.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(put, schema).drop("rank")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and offset.

    ``with_ids`` adds the ids themselves, from which ``sequences`` builds the packed rows.
    """
    return place(cut(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ids in order of offset, and the documents they come from."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p.ids, X'', (a, x) -> a || x)").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
