"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of fewer file splits than cores is dealt over all cores, since texts cost more to process than to move."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def packed(docs: DataFrame) -> DataFrame:
    from tidewell.llm.packing import pack_documents

    pieces = pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)
    return pieces.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.ngram import score_documents

    return score_documents(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.counting import count_tokens

    counted = count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op4_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.sharding import shard_documents

    sharded = shard_documents(documents(spark, sf_dir), n_shards=16)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.quality import judge

    return judge(documents(spark, sf_dir)).drop("rejected_by")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.decontaminate import contamination

    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", "n_items", "items_sha256", "contaminated")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.toxicity import learn, remainder, toxic_scores

    docs = documents(spark, sf_dir)
    model = learn(docs, table(spark, sf_dir, "labels"), remainder(F.col("_label_id"), 5) == 0)
    scored = toxic_scores(docs, model)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.jaccard import documents_of, link_components

    return link_components(documents_of(documents(spark, sf_dir)), width=3, percent=90)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.resampling import resample

    return resample(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.idfiles import round_trip

    return round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=2)


def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.neighbours import search

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = search(vectors, F.col("id") % 100 == 0, k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.fillmiddle import fill_in_middle, restore

    made = fill_in_middle(documents(spark, sf_dir), seed=42, percent=50, spm_percent=80)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore("output", "form"), 256).alias("restored_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.divergence import audit

    return audit(documents(spark, sf_dir), least_docs=10, top_terms=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_token_counts": op3_token_counts,
    "op4_histogram_sharding": op4_histogram_sharding,
    "op5_quality_rules": op5_quality_rules,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_id_files": op10_id_files,
    "op11_learned_partitions": op11_learned_partitions,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_divergence": op13_source_divergence,
}
