"""What only tables beyond the test scales show."""

from pyspark.sql import functions as F

from tidewell.plans.catalog import QUERIES


def test_of_two_updates_of_one_version_the_first_batch_stays(spark, tmp_path):
    """Keys of the third batch meet those of the first from 100,000 rows on."""
    ids = spark.createDataFrame([(100_005, 1), (5, 2), (100_020, 3), (20, 4)] + [(i, 0) for i in range(100_035, 100_300, 15)] + [(i, 7) for i in range(35, 300, 15)], "vec_id long, label int")
    ids.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    merged = QUERIES["q002_upsert"](spark, str(tmp_path)).where("vec_id >= 100000")
    assert "batch" in merged._jdf.queryExecution().optimizedPlan().toString()  # the order itself says which, not the order of arrival
    got = {r.vec_id: r.label for r in merged.collect()}
    labels = {r.vec_id: r.label for r in ids.collect()}
    for i in labels:
        if i >= 100_000 and i % 3 == 0:
            assert got[i] == labels[i] + (200 if i % 6 == 0 else 100)


def test_distinct_users_beyond_a_sketch_are_exact(spark, tmp_path):
    n = 9000  # a sketch has 4096 entries
    day = F.timestamp_add("DAY", (F.col("id") % 3).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    events = spark.range(2 * n).select(F.lit("view").alias("event_type"), day.alias("ts"), (F.col("id") % n).alias("user_id"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((str(r.day), r.seen, r.new) for r in QUERIES["q061_distinct_sketch"](spark, str(tmp_path)).collect())
    assert got == [("2024-01-01", 3000, 3000), ("2024-01-02", 6000, 3000), ("2024-01-03", 9000, 3000)]
