"""Stages of the corpus pipeline; each takes and returns documents, the last returns packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import queries


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the cascade keep."""
    from tidewell.llm.quality import keep_documents

    return keep_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    from tidewell.llm.toxicity import drop_toxic

    return drop_toxic(docs, queries.table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    from tidewell.llm.jaccard import keep_one_per_group

    return keep_one_per_group(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    from tidewell.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of what is left."""
    return queries.packed(docs)
