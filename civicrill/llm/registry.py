"""Queries of the corpus operators: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from civicrill.llm import alignment, audit, bpe, decontaminate, language, licenses, ordering, pii, preference, quality, secrets, simhash, toxicity
from civicrill.llm.common import documents, read


#: Key of the training order; another key gives another order of the same sequences.
TRAINING_KEY = "epoch-0"


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.earlier_answers(read(spark, sf_dir, "conversations"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = ordering.BytePairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ordering.shards(ordering.sequences(ordering.arranged(documents(spark, sf_dir)), tokens), TRAINING_KEY)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_license_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    return alignment.report(documents(spark, sf_dir), byte_level, public_tokenizers.path("piece_bpe_32k.model"))


def op13_language_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_ownership": op1_secret_ownership,
    "op2_pii_boosting": op2_pii_boosting,
    "op3_preference_pairs": op3_preference_pairs,
    "op4_training_order": op4_training_order,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_license_similarity": op7_license_similarity,
    "op8_quality_rules": op8_quality_rules,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_toxicity_chain": op10_toxicity_chain,
    "op11_filter_interactions": op11_filter_interactions,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_language_cross_parsing": op13_language_cross_parsing,
}

ORACLE: dict[str, str] = {"op3_preference_pairs": preference.EARLIER_ANSWERS, "op11_filter_interactions": audit.SQL}
