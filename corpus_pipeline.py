"""From raw documents to a training mix, stage by stage.

Each stage takes the documents that its predecessor kept and acts on what its
operator finds: bad texts go, one text of each group of near duplicates stays,
contaminated texts go, secrets are masked, and the mix draws the rest to its target
weights.

Rows may have null or repeated doc_ids: decisions are by text, or by doc_id and text.
Of rows that agree in both, the second stage keeps one.  Of a group of near duplicates
the row of the smallest doc_id stays (nulls come last).  Columns beyond those of
documents stay with their rows, but for those that the last stage adds.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocutide.llm.decontaminate import decontaminate
from ocutide.llm.jaccard_join import jaccard_components
from ocutide.llm.mixing import mix_rows
from ocutide.llm.quality_rules import keep_good
from ocutide.llm.secret_scan import redact
from ocutide.llm.storage import discard, free_name, small_batches, stored

#: Words of a shingle and least similarity of near duplicates (op10's digest has settings of its own).
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the fertility bands."""
    small_batches(spark)
    return keep_good(docs, public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row, of the smallest doc_id."""
    small_batches(spark)
    key = free_name("_row_key", docs)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), NEAR_SHINGLE, NEAR_PERCENT).select(F.col("doc_id").alias("k"), "component_id")
    names = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("named")).distinct()
    order = F.struct(F.col("named").isNull().alias("unnamed"), "named", "k")
    first = found.distinct().join(names, "k").groupBy("component_id").agg(F.min_by("k", order).alias(key)).select(key)
    # rows of one key agree in doc_id and text, and are combined before they move
    return keyed.join(first, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def not_in_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    key = free_name("_digest", docs)
    found = decontaminate(docs.select(F.md5("text").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    keyed = docs.withColumn(key, F.coalesce(F.md5("text"), F.uuid()))
    return keyed.join(found.where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their topic, number of tokens, weight and copies."""
    return mix_rows(docs).where("copies > 0")


STAGES = [
    ("quality_rules", good_texts),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", not_in_benchmarks),
    ("secret_scan", secrets_masked),
    ("mixing", mixed),
]
#: The vocabularies of the first stage are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        old, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(old)
    return STAGES[-1][1](spark, docs, sf_dir)
