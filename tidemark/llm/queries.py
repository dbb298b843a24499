"""The corpus operators as registered queries, each over its whole table, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, mixing, neighbours, packing, perplexity, pii, simhash, substrings, tokens, unit_dedup
from .common import scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokens.write_token_files(table(spark, sf_dir, "documents"), path)
    return tokens.read_token_files(spark, path, with_ids=False)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "mix_topic", "mix_tokens", "mix_probability")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.find_spans(table(spark, sf_dir, "documents")))


def op5_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.verdicts(perplexity.fit_rules(table(spark, sf_dir, "documents")))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_token_files": op2_token_files,
        "op3_source_mixing": op3_source_mixing,
        "op4_personal_data": op4_personal_data,
        "op5_unit_dedup": op5_unit_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_quality_rules": op9_quality_rules,
        "op10_nearest_neighbours": op10_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {}
