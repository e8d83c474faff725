"""Parts of texts lose the spaces at their ends and nothing else."""

from pyspark.sql import functions as F

from tidewell.functions import texts


def parts(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("p")).first()["p"]


def test_blocks_keep_digits_that_equal_their_place(spark):
    """A transform of two arguments would trim the part's number and leave its spaces."""
    got = parts(spark, "0 ten 0\n  1 two 1 \n　call 555-8972\t", texts.blocks_of("t", "\n", 1))
    assert got == ["0 ten 0", "1 two 1", "call 555-8972\t"]
    assert parts(spark, "1 a 1\n## 2 b 2", texts.heading_blocks(F.concat(F.lit("## "), "t"), 0)) == ["1 a 1", "2 b 2"]


def test_sections_keep_their_last_digit(spark, tmp_path):
    from tidewell.plans.catalog import QUERIES

    line = "a line of more than forty characters, number "
    spark.createDataFrame([(7, f"{line}0\n{line}1 \n{line}2")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.chunk for r in QUERIES["q139_section_chunks"](spark, str(tmp_path)).orderBy("section").collect()]
    assert got == [f"## {line}0", f"### {line}1", f"### {line}2"]


def test_code_blocks_keep_digits_that_equal_their_place(spark):
    from tidewell.functions.code import linear_chunks

    assert parts(spark, "x = 0\n\n y = 1 \n\nz = 2", linear_chunks("t")) == ["x = 0", "y = 1", "z = 2"]
