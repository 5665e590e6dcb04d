"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe_codec, fingerprint_index, importance, language_id, near_dedup, neighbours, ordered_packing, packing, quality, suffix_dedup, token_counts, token_files
from .scratch import new_path


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).withColumnRenamed("n", "n_bytes")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op5_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.deduplicate(table(spark, sf_dir, "documents")).withColumnRenamed("n", "n_words").drop("n_spans")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.encode_table(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    return language_id.identify(docs, model).select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), out, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, out, ids=False).withColumnRenamed("key", "doc_id")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return told.select("doc_id", "n_features", "weight", "score", "rank")


def op12_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return told.select("doc_id", *alignment.COUNTS, F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_best_fit_packing, op4_quality_rules, op5_fingerprint_index, op6_bpe_codec, op7_language_id, op8_nearest_neighbours, op9_token_files, op10_near_dedup, op11_importance_resampling, op12_ordered_packing, op13_tokenizer_alignment)}
SQL: dict[str, str] = {"op4_quality_rules": quality.SQL, "op11_importance_resampling": importance.SQL}
