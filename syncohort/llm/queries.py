"""The subpackage's registered queries, each over its whole table, and SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syncohort.llm import (
    fingerprints,
    hard_negatives,
    licenses,
    line_dedup,
    mixing,
    near_duplicates,
    packing,
    pii,
    quality,
    secrets,
    suffixes,
    urls,
    whitening,
)
from syncohort.llm.checks import CHECKS as CHECKS

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed", "source_ids")


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), size=4, percent=80)


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "source", "copy", "block", "release", "deadline", "slot", "offset"
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER)


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.quality_rules(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )
    return judged.drop("text_hash", "threshold")


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op9_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, folder, "documents"))


def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"))


def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        table(spark, folder, "embeddings").withColumn("label", label)
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_fingerprints, op3_minhash, op4_mixing, op5_packing, op6_licenses,
        op7_quality, op8_pii, op9_suffixes, op10_urls, op11_secrets, op12_whitening,
        op13_hard_negatives,
    )
}
