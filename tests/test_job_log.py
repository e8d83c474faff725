"""The job log's data source: batch and stream agree, also after a restart; filters reach the reader."""

from pyspark.sql import functions as F

from tidewell.sources import job_log
from tidewell.sources.job_log import LogReader, log_files, register
from tidewell.sources.job_stream import append_events, read_events


def rows(frame):
    return sorted((r.job_id, r.seq, r.event) for r in frame.select("job_id", "seq", "event").collect())


def events(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("j"), F.col("id") % 11).alias("job_id"), F.col("id").alias("seq"), F.when(F.col("id") % 7 != 0, 'say "x"\nü').alias("event"))


def test_batch_stream_and_restart(spark, tmp_path):
    log, state, out = str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "out")
    register(spark)

    def run():
        stream = spark.readStream.format("job_log").load(log)
        q = stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(out)

    append_events(events(spark, 0, 200), log)
    assert rows(spark.read.format("job_log").load(log)) == rows(events(spark, 0, 200)) == rows(run())
    append_events(events(spark, 200, 260), log)
    append_events(events(spark, 260, 300), log)
    assert rows(run()) == rows(spark.read.format("job_log").load(log)) == rows(read_events(spark, log)) == rows(events(spark, 0, 300))
    assert rows(run()) == rows(events(spark, 0, 300))  # nothing new


def test_filters_reach_the_reader(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    log = str(tmp_path / "log")
    append_events(events(spark, 0, 300), log)
    reader = LogReader(log)
    assert list(reader.pushFilters([In(("job_id",), ("j1", "j2")), EqualTo(("job_id",), "j2"), GreaterThan(("seq",), 99), IsNotNull(("seq",))])) == [IsNotNull(("seq",))]
    parts = reader.partitions()
    assert len(parts) < len(log_files(log)) and len({p.bucket for p in parts}) == 1
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["seq"] for r in got) == [k for k in range(100, 300) if k % 11 == 2]
    register(spark)
    frame = spark.read.format("job_log").load(log).where((F.col("job_id") == "j2") & (F.col("seq") > 99))
    assert rows(frame) == rows(events(spark, 100, 300).where("job_id = 'j2'"))


def test_small_batches_and_no_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(job_log, "BATCH", 3)
    log = str(tmp_path / "log")
    assert log_files(log) == []
    append_events(events(spark, 0, 50), log)
    reader = LogReader("file://" + log)
    assert sorted(r["seq"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()) == list(range(50))
