"""The job event log as a data source of its own, ``spark.read.format("job_log")`` and ``readStream``.

A log is what ``job_stream.append_events`` writes: JSON lines in folders by bucket of the
job.  A batch reads one partition a file; filters on ``job_id`` leave only those jobs'
folders, filters on ``seq`` drop rows before they leave the reader.  A stream's offset
is the latest change time of a file and the names of the files of that time, so a query that starts again from its
checkpoint goes on where it stood.  Files go through pyarrow's file systems, so a path
may be local or in any store that those open.

``register(spark)`` makes the format known and lets filters reach readers.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from tidewell.sources.job_stream import BUCKETS, SCHEMA

ROWS = pa.schema([("job_id", pa.string()), ("seq", pa.int64()), ("event", pa.string()), ("bucket", pa.int32())])
#: Rows of a batch that a reader hands on.
BATCH = 4096


class LogFile(InputPartition):
    """One file, its bucket, and what is asked of it."""

    def __init__(self, path: str, bucket: int, jobs: list[str] | None, least: int | None) -> None:
        self.path, self.bucket, self.jobs, self.least = path, bucket, jobs, least


def log_files(path: str) -> list[tuple[int, str, int]]:
    """Change time in nanoseconds, path and bucket of every file of a log, in order."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    out = []
    for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        folder, hidden = f.path.rsplit("/", 2)[1], f.base_name[0] in "._"
        if f.type == fs.FileType.File and not hidden and folder.startswith("bucket=") and "/_temporary/" not in f.path:
            out.append((f.mtime_ns, f.path, int(folder.removeprefix("bucket="))))
    return sorted(out)


def read_file(path: str, root: str, bucket: int, jobs: Iterable[str] | None, least: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of a file that are asked for, batch by batch."""
    system = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
    wanted, held = None if jobs is None else set(jobs), []
    with system.open_input_stream(path) as stream:
        rest = b""
        while chunk := stream.read(1 << 20):
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                if line.strip() and (row := _asked(json.loads(line), wanted, least)):
                    held.append((*row, bucket))
            if len(held) >= BATCH:
                yield _batch(held)
                held = []
    if rest.strip() and (row := _asked(json.loads(rest), wanted, least)):
        held.append((*row, bucket))
    if held:
        yield _batch(held)


def _asked(row: dict, jobs: set[str] | None, least: int | None) -> tuple | None:
    job, seq = row.get("job_id"), row.get("seq")
    if (jobs is not None and job not in jobs) or (least is not None and (seq is None or seq < least)):
        return None
    return job, seq, row.get("event")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ROWS.types)], schema=ROWS)


class LogReader(DataSourceReader):
    """Reads the files of the buckets that filters leave."""

    def __init__(self, path: str) -> None:
        self.path, self.jobs, self.least = path, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("job_id",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.jobs = values if self.jobs is None else self.jobs & values
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("seq",):
                low = f.value + isinstance(f, GreaterThan)
                self.least = low if self.least is None else max(self.least, low)
            else:
                yield f

    def partitions(self) -> list[LogFile]:
        buckets = None if self.jobs is None else {zlib.crc32(j.encode()) % BUCKETS for j in self.jobs}
        jobs = None if self.jobs is None else sorted(self.jobs)
        return [LogFile(path, b, jobs, self.least) for _, path, b in log_files(self.path) if buckets is None or b in buckets]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        yield from read_file(partition.path, self.path, partition.bucket, partition.jobs, partition.least)


class LogStream(DataSourceStreamReader):
    """Reads files in the order of their change; an offset names the last time and the files of that time."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"at": -1, "files": []}

    def latestOffset(self) -> dict:
        files = log_files(self.path)
        last = files[-1][0] if files else -1
        return {"at": last, "files": [p for at, p, _ in files if at == last]}

    def partitions(self, start: dict, end: dict) -> list[LogFile]:
        new = [(at, p, b) for at, p, b in log_files(self.path) if (start["at"] < at or (start["at"] == at and p not in start["files"])) and (at < end["at"] or (at == end["at"] and p in end["files"]))]
        return [LogFile(p, b, None, None) for _, p, b in new]

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        yield from read_file(partition.path, self.path, partition.bucket, None, None)


class JobLog(DataSource):
    """``load(path)``, or the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "job_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> LogReader:
        return LogReader(self.options["path"])

    def streamReader(self, schema: object) -> LogStream:
        return LogStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session; Spark asks for pushed filters to be switched on where a source takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(JobLog)
