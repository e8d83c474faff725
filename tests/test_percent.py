def test_half_a_percent_is_rounded_up(spark):
    """33 of 40 over three layers is 27.5 percent; the mean times 100 fell below it."""
    from pyspark.sql import functions as F

    from tidewell.operators.learning import coverage_summary

    rows = spark.range(40).select(F.lit(1).alias("u"), "id")
    never = F.col("id") < 0
    got = coverage_summary(rows, ["u"], never, {"why": F.col("id") < 33, "how": never, "mechanic": never}).first()
    assert got.overall == 28 and got.why == 0.825
