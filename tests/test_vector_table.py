"""Merges by id: repeated ids, two writers, batches that run again."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators.tables import upsert
from tidewell.sources.vector_table import SCHEMA, Conflict, VectorTable


def rows(spark, *items):
    return spark.createDataFrame([(i, [float(x), 1.0], {"n": str(x)}, "m") for i, x in items], SCHEMA)


def held(table):
    got = [(r.id, r.payload["n"]) for r in table.rows().collect()]
    assert len(got) == len({i for i, _ in got})
    return dict(got)


def test_a_repeated_id_needs_an_order(spark, tmp_path):
    base = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1)], "id int, v string, at int")
    assert sorted(map(tuple, upsert(base, twice, "id", F.desc("at")).collect())) == [(1, "b"), (2, "old"), (3, "c")]
    with pytest.raises(Exception, match="two rows have one id: 1"):
        upsert(base, twice, "id").collect()
    table = VectorTable(spark, str(tmp_path / "t"))
    table.create()
    with pytest.raises(Exception, match="two rows have one id: a"):
        table.upsert(rows(spark, ("a", 1), ("a", 2)))
    assert table.count() == 0 and table.version() == 1
    table.upsert(rows(spark, ("a", 1), ("a", 2), ("b", 3)), F.desc(F.col("payload")["n"]))
    assert held(table) == {"a": "2", "b": "3"}


def test_two_writers_from_one_version_are_both_kept(spark, tmp_path, monkeypatch):
    first, second = (VectorTable(spark, str(tmp_path / "t")) for _ in range(2))
    assert first.create() and not second.create()
    publish, between = VectorTable._publish, []

    def late(self, change, at, batches):
        if self is second and not between:
            between.append(first.upsert(rows(spark, ("a", 1))))  # another writer comes in between reading and publishing
        return publish(self, change, at, batches)

    monkeypatch.setattr(VectorTable, "_publish", late)
    assert second.upsert(rows(spark, ("b", 2))) == 3 and between == [2]
    assert held(first) == {"a": "1", "b": "2"}
    between.clear()
    second.retries = 0
    with pytest.raises(Conflict):
        second.upsert(rows(spark, ("c", 3)))
    assert held(second) == {"a": "1", "b": "2"}
    first.vacuum(keep=1)
    assert held(first) == {"a": "1", "b": "2"} and len(list((tmp_path / "t").iterdir())) == 2


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, monkeypatch):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    table = VectorTable(spark, str(tmp_path / "t"))
    table.create()

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)

    rows(spark, ("a", 1), ("b", 1)).coalesce(1).write.parquet(source)
    table.merge_stream(stream(), "in", state)
    assert held(table) == {"a": "1", "b": "1"}
    rows(spark, ("b", 2), ("c", 2)).coalesce(1).write.mode("append").parquet(source)
    publish = VectorTable._publish

    def dies_after(self, *args):
        publish(self, *args)
        raise OSError("lost before the stream could note its batch")

    monkeypatch.setattr(VectorTable, "_publish", dies_after)
    with pytest.raises(Exception, match="lost before"):
        table.merge_stream(stream(), "in", state)
    version = table.version()
    monkeypatch.setattr(VectorTable, "_publish", publish)
    table.upsert(rows(spark, ("b", 9)))  # must outlive the batch that runs again
    table.merge_stream(stream(), "in", state)
    assert held(table) == {"a": "1", "b": "9", "c": "2"} and table.version() == version + 1

    rows(spark, ("d", 4)).coalesce(1).write.mode("append").parquet(source)

    def dies_before(self, *args):
        raise OSError("lost before the pointer")

    monkeypatch.setattr(VectorTable, "_publish", dies_before)
    with pytest.raises(Exception, match="lost before the pointer"):
        table.merge_stream(stream(), "in", state)
    monkeypatch.setattr(VectorTable, "_publish", publish)
    table.merge_stream(stream(), "in", state)
    assert held(table) == {"a": "1", "b": "9", "c": "2", "d": "4"}
