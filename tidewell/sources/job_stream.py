"""Append-only event lists of jobs, as JSON lines in a fixed number of folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "job_id string, seq long, event string, bucket int"
#: Folders; a job's events lie in one of them.
BUCKETS = 32


def bucket_of(job_id: str | F.Column) -> F.Column:
    return (F.crc32(F.encode(F.lit(job_id) if isinstance(job_id, str) else job_id, "UTF-8")) % BUCKETS).cast("int")


def append_events(events: DataFrame, path: str) -> None:
    """Append rows of ``job_id, seq, event``."""
    rows = events.select(F.col("job_id").cast("string").alias("job_id"), "seq", "event").withColumn("bucket", bucket_of(F.col("job_id")))
    rows.repartition(BUCKETS, "bucket").write.mode("append").partitionBy("bucket").json(path)


def read_events(spark: SparkSession, path: str, jobs: Sequence[str] | None = None, start: int = 0) -> DataFrame:
    """Events of jobs from an offset on; for given jobs only their folders are read."""
    rows = spark.read.schema(SCHEMA).json(path)
    if jobs is not None:
        folders = [r.b for r in spark.range(1).select(F.explode(F.array(*[bucket_of(j) for j in jobs])).alias("b")).distinct().collect()] if jobs else []
        rows = rows.where(F.col("bucket").isin(folders) & F.col("job_id").isin(list(jobs)))
    offset = F.row_number().over(Window.partitionBy("job_id").orderBy("seq")) - 1
    return rows.drop("bucket").withColumn("offset", offset).where(F.col("offset") >= start)


def tail(spark: SparkSession, path: str) -> DataFrame:
    """Events as they come, as a stream."""
    return spark.readStream.schema(SCHEMA).json(path)
