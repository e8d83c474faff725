"""A folder of text files, such as a checked-out repository, as one corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are read, and folders that are passed over (fixed values).
LANGUAGE_SUFFIXES = (".py", ".pyi", ".pyw", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".tsx", ".go", ".rs", ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hxx", ".java", ".cs", ".rb", ".php", ".kt", ".swift")
TEXT_SUFFIXES = (".md", ".txt", ".json", ".yaml", ".yml", ".rst")
SKIPPED_FOLDERS = (".git", "node_modules", "vendor", "venv", ".venv", "dist", "build", "__pycache__", ".idea", ".vscode")


def read_files(spark: SparkSession, folder: str, suffixes: Sequence[str] = (*LANGUAGE_SUFFIXES, *TEXT_SUFFIXES), max_bytes: int = 100 * 1024) -> DataFrame:
    """``path, content, size`` of a folder's text files; paths are relative to it.

    Files of other suffixes, in skipped folders, larger than the limit, binary or blank
    are left out; bytes that aren't UTF-8 become replacement characters.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.expr(f"substring(path, {len(root) + 2})")
    known = F.lower(path).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    skipped = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in SKIPPED_FOLDERS]))
    text = files.where((F.col("length") <= max_bytes) & known & ~skipped).select(path.alias("path"), "content", F.col("length").alias("size"))
    binary = F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, 1024)), "(..)", "$1 ")) > 0
    decoded = text.where(~binary).withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
    return decoded.where(F.regexp_replace("content", r"\s", "") != "")


def corpus(files: DataFrame) -> DataFrame:
    """``text, files``: one row, the files in order of path, each under its name; a folder is one bounded repository."""
    part = F.concat(F.lit("### "), "path", F.lit("\n"), F.regexp_replace("content", r"^\s+|\s+$", ""))
    ordered = F.array_sort(F.collect_list(F.struct("path", part.alias("part"))))
    return files.agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("files"))
