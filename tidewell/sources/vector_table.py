"""A vector table stored as Parquet, partitioned by embedding space."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.vectors import cosine
from tidewell.operators.tables import of_space, upsert
from tidewell.streaming.run import remove

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
        T.StructField("embed_model", T.StringType(), False),
    ]
)


class Conflict(RuntimeError):
    """Another writer has published the version that this one wanted to."""


class VectorTable:
    """Create, upsert, search and delete by path; every change writes a new version folder and then its pointer.

    Versions are numbered.  A pointer is a file named by its number, which the file
    system creates only if there is none, so of two writers that start from one version
    the second is refused; it reads the new version and applies its change again.  A
    reader sees one whole version.  A pointer also holds the last batch of each stream
    that was merged, so a batch that runs again after a crash changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, retries: int = 5) -> None:
        self.spark, self.path, self.retries = spark, path.rstrip("/"), retries

    def create(self) -> bool:
        """Write an empty table unless there is one; True if it was written."""
        if self.version():
            return False
        try:
            self._publish(self.spark.createDataFrame([], SCHEMA), 0, {})
        except Conflict:
            return False
        return True

    def version(self) -> int:
        """The number of the newest version, 0 if there is no table."""
        folder, files = self._files(f"{self.path}/pointer")
        return max((int(f.getPath().getName()) for f in files.listStatus(folder)), default=0) if files.exists(folder) else 0

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of a numbered one."""
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{self._pointer(version or self.version())['folder']}")

    def upsert(self, rows: DataFrame, *order: Column, batch: tuple[str, int] | None = None) -> int:
        """Merge by id and return the version; of rows with one id the first in order stays, without an order they are an error.

        ``batch`` names a stream and the number of its batch; one that was merged before is skipped.
        """
        return self._change(lambda now: upsert(now, rows.select(*dict.fromkeys([*SCHEMA.names, *rows.columns])), "id", *order), batch)

    def delete(self, condition: Column) -> int:
        return self._change(lambda now: now.where(~F.coalesce(condition, F.lit(False))))

    def merge_stream(self, stream: DataFrame, name: str, state: str, *order: Column) -> None:
        """Merge what a stream has now, batch by batch; ``state`` is its checkpoint folder.

        Each batch and its number are published together, so running it again is safe.
        """

        def merge(batch: DataFrame, number: int) -> None:
            self.upsert(batch, *order, batch=(name, number))

        query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    def vacuum(self, keep: int = 2) -> None:
        """Delete the folders of all but the newest versions, and what no pointer names; not while others read or write."""
        last = self.version()
        kept = {self._pointer(v)["folder"] for v in range(max(1, last - keep + 1), last + 1)}
        folder, files = self._files(self.path)
        for f in files.listStatus(folder):
            if (name := f.getPath().getName()) != "pointer" and name not in kept:
                remove(self.spark, f"{self.path}/{name}")

    def count(self, condition: Column | None = None) -> int:
        rows = self.rows()
        return (rows if condition is None else rows.where(condition)).count()

    def search(self, vector: list[float], model: str, limit: int = 10, where: Column | None = None, digits: int | None = None) -> DataFrame:
        """Nearest rows of a space by cosine; filters and the space prune before any distance is computed."""
        rows = of_space(self.rows(), model)
        rows = rows.where(where) if where is not None else rows
        score = cosine("embedding", F.lit([float(x) for x in vector]))
        score = score if digits is None else F.round(score, digits)
        return rows.withColumn("_score", score).orderBy(F.desc("_score"), "id").limit(limit)

    def _files(self, path: str) -> tuple:
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(context._jsc.hadoopConfiguration())

    def _pointer(self, version: int) -> dict:
        if not version:
            raise FileNotFoundError(f"no table in {self.path}")
        return json.loads(self.spark.read.text(f"{self.path}/pointer/{version:09d}").first().value)

    def _change(self, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        for turn in range(self.retries + 1):
            at = self.version()
            batches = self._pointer(at)["batches"]
            if batch and batches.get(batch[0], -1) >= batch[1]:
                return at
            try:
                return self._publish(change(self.rows(at)), at, batches | (dict([batch]) if batch else {}))
            except Conflict:
                if turn == self.retries:
                    raise
        raise AssertionError("unreachable")

    def _publish(self, rows: DataFrame, at: int, batches: dict[str, int]) -> int:
        folder = f"v-{uuid.uuid4().hex}"
        rows.write.partitionBy("embed_model").parquet(f"{self.path}/{folder}")
        if not self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/{folder}").limit(1).count():
            rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")  # an empty partitioned write leaves no schema
        place, files = self._files(f"{self.path}/pointer/{at + 1:09d}")
        try:
            out = files.create(place, False)
        except Py4JJavaError as e:
            remove(self.spark, f"{self.path}/{folder}")
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {at + 1} of {self.path} is there already") from e
            raise
        out.write(bytearray(json.dumps({"folder": folder, "batches": batches}).encode()))
        out.close()
        return at + 1
