"""The operators over whole tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import (
    exact_dedup,
    exact_search,
    filter_audit,
    hard_negatives,
    license_scan,
    mixing,
    order_minhash,
    packing,
    quality,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
)
from holdfast.llm.tables import documents, embeddings, labels

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, folder), public_tokenizers.path(BYTE_BPE))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_matches(documents(spark, folder))


def op3_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.order_fingerprints(documents(spark, folder))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, folder))


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeat_report(documents(spark, folder))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), public_tokenizers.path(BYTE_BPE))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, folder))


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(documents(spark, folder), labels(spark, folder))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, folder), labels(spark, folder))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_interactions(documents(spark, folder), labels(spark, folder))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mined(embeddings(spark, folder))


def op13_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    return exact_search.search_report(embeddings(spark, folder))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}
