"""Copies of tables between formats."""

from __future__ import annotations

from pyspark.sql import DataFrame


def copy_table(rows: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Write rows under ``path`` in another format and read them back with the same schema."""
    rows.write.mode("overwrite").format(kind).save(path)
    return rows.sparkSession.read.format(kind).schema(rows.schema).load(path)
