"""Helpers shared by the operators: checkpoints, Arrow batches, counters."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.streaming.run import remove, scratch, shared_folder

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on exactly these.
SPACE_BYTES = b" \t\n\r\x0b\x0c"

#: Texts in one Python batch; with the byte bound below it limits a worker's memory.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path for a written table in the shared folder; it goes when the driver ends."""
    return scratch(spark, what)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """Add a key of the physical row, so that repeated ids stay apart."""
    return df.withColumn(name, F.monotonically_increasing_id())


@lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release_memory() -> None:
    """Hand freed memory back to the system: a worker serves many tasks beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


_kept: dict[str, Any] = {}


def kept_in_worker(key: str, make: Callable[[], Any]) -> Any:
    """What tasks of one kind keep in their Python worker; a worker holds one such thing at a time."""
    if key not in _kept:
        forget()
        _kept[key] = make()
        release_memory()
    return _kept[key]


def forget() -> None:
    """Let go what tasks of another kind kept in this worker, so that stages don't add up."""
    if _kept:
        _kept.clear()
        release_memory()


def text_batches(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of ``batch`` of bounded rows and bytes with their texts; null counts as empty."""
    sizes = pyarrow.compute.fill_null(pyarrow.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= BATCH_ROWS or total + n > BATCH_BYTES):
            part = batch.slice(start, i - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        part = batch.slice(start)
        yield part, [t or "" for t in part.column(column).to_pylist()]
    release_memory()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def chain64(*parts: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of equally long arrays of hashes."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        out = mix64(out ^ p) * _GOLD + p
    return out


def pack_counters(values: np.ndarray, slice_size: int) -> Iterator[tuple[int, bytes]]:
    """Non-empty slices of a counter array, deflated."""
    for k in range(0, len(values), slice_size):
        piece = values[k : k + slice_size]
        if piece.any():
            yield k // slice_size, zlib.compress(piece.tobytes(), 1)


def sum_counters(slices: DataFrame, length: int, slice_size: int, dtype: str = "int64") -> np.ndarray:
    """Sum counter slices (``slice int, payload binary``) of all tasks.

    Slices of 256 tasks each are summed first, then those sums, so that no group holds
    a payload of every task.  The result has a fixed ``length`` whatever the input, so
    the driver holds a bounded array.
    """

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = None
        for payload in table.column("payload"):
            got = np.frombuffer(zlib.decompress(payload.as_py()), dtype)
            total = got.copy() if total is None else total + got
        return pa.table({"slice": [key[0].as_py()], "payload": [zlib.compress(total.tobytes(), 1)]}, schema=pa.schema([("slice", pa.int32()), ("payload", pa.binary())]))

    out = np.zeros(length, dtype)
    summed = slices.withColumn("part", F.floor(F.spark_partition_id() / 256)).groupBy("slice", "part").applyInArrow(add, "slice int, payload binary")
    for row in summed.groupBy("slice").applyInArrow(add, "slice int, payload binary").collect():
        got = np.frombuffer(zlib.decompress(bytes(row.payload)), dtype)
        out[row.slice * slice_size : row.slice * slice_size + len(got)] = got
    return out
