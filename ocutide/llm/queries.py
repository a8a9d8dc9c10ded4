"""Queries of the corpus operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ocutide.llm import chat_format, decontaminate, jaccard_join, license_scan, mixing, quality_rules, secret_scan, substring_dedup, token_counts, toxicity
from ocutide.llm.storage import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(secret_scan.secret_scan(_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = chat_format.with_probe(_table(spark, sf_dir, "conversations"))
    return chat_format.conversation_digests(chat_format.format_turns(talks))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.decontamination_digests(found)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_quality_rules, op4_chat_format, op5_token_counts, op6_mixing, op7_substring_dedup, op8_license_scan, op9_decontaminate, op10_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secret_scan.SQL, "op4_chat_format": chat_format.SQL, "op6_mixing": mixing.SQL, "op9_decontaminate": decontaminate.SQL, "op10_jaccard_join": jaccard_join.SQL}
