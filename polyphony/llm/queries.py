"""Registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polyphony.llm import abuse, langid, leakage, near_dup, packing, pairs, tokens, truncation


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_pairs(_t(spark, d, "responses"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_groups(_t(spark, d, "responses"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.label_issues(_t(spark, d, "responses"), _t(spark, d, "oasst2_prompts"))


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(langid.subjects(_t(spark, d, "responses"), _t(spark, d, "oasst2_prompts")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_t(spark, d, "responses"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(_t(spark, d, "responses"))


def p4_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(_t(spark, d, "responses"), _t(spark, d, "documents"))


def p4_record_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count_tokens(tokens.corpus_rows(_t(spark, d, "responses"), _t(spark, d, "documents")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(_t(spark, d, "responses"), _t(spark, d, "oasst2_prompts"))


def p6_assignment(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_t(spark, d, "documents"), _t(spark, d, "containers"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(p6_assignment(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.flagged(_t(spark, d, "documents"), _t(spark, d, "doc_labels"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_t(spark, d, "documents"), _t(spark, d, "doc_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (
        p1_found, p1_groups, p2_found, p2_languages, p3_found, p3_rates, p4_token_budget, p4_record_tokens,
        p5_found, p6_assignment, p6_fill, p7_found, p8_found, p8_rates,
    )
    return {f.__name__: f for f in fs}
