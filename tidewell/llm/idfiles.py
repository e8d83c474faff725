"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in descending corpus frequency, so common ids take
one byte.  Each value is coded in 1 to 4 bytes; the byte counts, two bits each,
stand in a separate control stream, four values to a control byte.  Decoding looks
up, for each control byte, the four lengths in a table of 256 rows and gathers the
bytes with numpy, without a loop over values.

Files are Parquet tables, so any file system, Spark's commit protocol and lost
executors are covered; each row is a segment:

    part, segment   place in the order of documents
    doc_ids         ids of the documents, an array of longs that may hold nulls
    lengths         ids of each document, unsigned 32-bit
    control, data   the two streams
    n_ids           ids of the segment

and ``ranks`` beside them holds the id of each rank.  Documents are in ascending
order of id over ``(part, segment)``; a null id comes first.

Defined results: a null or empty text holds the end id alone; rows that repeat an
id are documents of their own; texts of any length are encoded whole, each within one
segment; columns beyond id and text are ignored; an empty table gives files without
documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import cut, pack_counters, scratch_path, sum_counters, text_batches, with_row_key
from tidewell.llm.tokens import encoder

SLICE = 8192
#: Ids of a segment; bounds what a reader holds at once.
SEGMENT_IDS = 1 << 20

#: Bytes of the four values of each control byte, and their sum.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data streams of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    n = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = n - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    widest = int(n.max(initial=1))  # as a rule two bytes hold the largest rank
    raw = values.view(np.uint8).reshape(-1, 4) if widest > 2 else values.astype("<u2").view(np.uint8).reshape(-1, 2)
    return control.astype(np.uint8).tobytes(), raw[np.arange(raw.shape[1], dtype=np.uint8) < n[:, None]].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values of both streams, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    width = 4 if int(lengths.max(initial=1)) > 2 else 2
    raw = np.zeros((n, width), np.uint8)
    raw[np.arange(width, dtype=np.uint8) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return raw.view(f"<u{width}").reshape(-1).astype(np.uint32, copy=False)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents with deflated ids, and rows of id counts (``slice`` set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        pack, counts = zstandard.ZstdCompressor(level=1), np.zeros(vocabulary, np.int64)
        for whole in batches:
            for batch, texts in text_batches(whole, "text"):
                out = []
                ids_of = [np.frombuffer(b + end, "<u4") for b in code.encode(texts)]
                counts += np.bincount(np.concatenate(ids_of), minlength=vocabulary)
                for ids in ids_of:
                    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T if vocabulary > 1 << 16 else ids.astype("<u2").view(np.uint8).reshape(-1, 2).T
                    out.append(pack.compress(np.ascontiguousarray(planes).tobytes()))
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array([len(i) for i in ids_of], pa.int32()), pa.array(out, pa.binary()), pa.nulls(n, pa.int32())], ["_row", "doc_id", "n", "payload", "slice"])
        for k, payload in pack_counters(counts, SLICE):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([payload], pa.binary()), pa.array([k], pa.int32())], ["_row", "doc_id", "n", "payload", "slice"])

    source = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return source.mapInArrow(run, "_row long, doc_id long, n int, payload binary, slice int")


def write_id_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Tokenize all documents and write their ids under ``path`` in ascending order of id."""
    spark = docs.sparkSession
    vocabulary = max(encoder(tokenizer).library.get_vocab_size(), end_id + 1)
    both = cut(tokenized(docs, tokenizer, end_id, vocabulary, id_col, text_col))
    counts = sum_counters(both.where(F.col("slice").isNotNull()).select("slice", "payload"), vocabulary, SLICE)
    by_rank = np.argsort(-counts, kind="stable").astype(np.uint32)
    rank = np.empty(vocabulary, np.uint32)
    rank[by_rank] = np.arange(vocabulary, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, unpack, ranks = TaskContext.get().partitionId(), zstandard.ZstdDecompressor(), shared.value
        docs_, lengths, held, total, segment = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            control, data = encode_values(ranks[np.concatenate(held)])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([docs_], pa.list_(pa.int64())), pa.array([np.array(lengths, "<u4").tobytes()], pa.binary()), pa.array([control], pa.binary()), pa.array([data], pa.binary()), pa.array([total], pa.int64())],
                ["part", "segment", "doc_ids", "lengths", "control", "data", "n_ids"],
            )

        for batch in batches:
            for doc, n, payload in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("payload")):
                raw = np.frombuffer(unpack.decompress(payload.as_py()), np.uint8)
                planes = np.ascontiguousarray(raw.reshape(-1, n).T)
                held.append(planes.view("<u4" if planes.shape[1] == 4 else "<u2").reshape(-1))
                docs_.append(doc)
                lengths.append(n)
                total += n
                if total >= SEGMENT_IDS:
                    yield out()
                    docs_, lengths, held, total, segment = [], [], [], 0, segment + 1
        if held:
            yield out()

    rows = both.where(F.col("slice").isNull()).select("doc_id", "_row", "n", "payload")
    order = ["doc_id", "_row"]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    segments = ranged.sortWithinPartitions(*order).mapInArrow(run, "part int, segment int, doc_ids array<long>, lengths binary, control binary, data binary, n_ids long")
    segments.write.option("compression", "zstd").parquet(f"{path}/segments")
    spark.createDataFrame([(by_rank.tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")


def read_id_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, their ids."""
    by_rank = np.frombuffer(bytes(spark.read.parquet(f"{path}/ranks").first().ids), np.uint32)
    ids = spark.sparkContext.broadcast(by_rank)
    segments = spark.read.parquet(f"{path}/segments")
    # places: one row per part first, then the segments of each part
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.select("part", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("first")).join(parts, "part")
    starts = placed.select("part", "segment", (F.col("first") + F.col("part_start")).alias("first"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, segment int" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                values = ids.value[decode_values(row["control"], row["data"], row["n_ids"])].astype("<u4")
                ends = np.cumsum(n)
                raw = [values[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                same = lambda x: pa.array(np.full(len(n), x, np.int32))
                arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array([zlib.crc32(r) for r in raw], pa.int64()), same(row["part"]), same(row["segment"])]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "part", "segment"]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(raw, pa.binary())] if with_ids else []), names + (["ids"] if with_ids else []))

    decoded = segments.mapInArrow(run, schema)
    whole = decoded.join(starts, ["part", "segment"]).withColumn("start", F.col("start") + F.col("first"))
    return whole.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "ids")
    write_id_files(docs, path, tokenizer, end_id, id_col, text_col)
    return read_id_files(docs.sparkSession, path)
