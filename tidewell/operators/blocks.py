"""Blocks of rows that meet each other where they lie, so no row is sent once for each block that it meets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tidewell.streaming.run import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def to_bytes(table: pa.Table) -> bytes:
    """A table as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()


def packed(rows: DataFrame, by: Sequence[str], number: int) -> DataFrame:
    """``by`` and ``payload``: the other columns of each value of ``by``, some ``number`` bounded groups, as one row that is computed once."""
    kept = [c for c in rows.columns if c not in by]

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        named = {c: pa.array([k.as_py()], k.type) for c, k in zip(by, key)}
        return pa.table(named | {"payload": pa.array([to_bytes(group.select(kept).combine_chunks())], pa.binary())})

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return cut(rows.repartition(number, *by).groupBy(*by).applyInArrow(pack, f"{schema}, payload binary").coalesce(number))


def each_pair(left: DataFrame, right: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows of blocks beside each other; a task reads the blocks of one part of each side, nothing is exchanged or broadcast."""
    near = left.hint("shuffle_replicate_nl")
    return near.crossJoin(right) if where is None else near.join(right, where)


def pairs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    """The rows of batches one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(n)[i] for n, name in enumerate(batch.schema.names)}
