"""Registered queries of the subpackage: ``QUERIES`` and, where SQL can say it, ``ORACLE``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (chat, compression, decontaminate, divergence, html_extract, line_dedup, minhash, packing, periodic,
               quality_rules, suffix_dedup, toxicity, url_filter)
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_line_dedup", line_dedup.ORACLE)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(read_table(spark, sf_dir, "documents"))


@register("op10_minhash_near_dedup")
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup_digest(read_table(spark, sf_dir, "documents"))


@register("op8_benchmark_decontamination", decontaminate.ORACLE)
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(read_table(spark, sf_dir, "documents"),
                                              read_table(spark, sf_dir, "benchmark"))


@register("op5_quality_rules", quality_rules.ORACLE)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules_digest(read_table(spark, sf_dir, "documents"))


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality_digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op6_chat_formatting", chat.ORACLE)
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(read_table(spark, sf_dir, "conversations"))


@register("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings_digest(read_table(spark, sf_dir, "documents"))


@register("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_digest(read_table(spark, sf_dir, "pages"))


@register("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_digest(read_table(spark, sf_dir, "documents"))


@register("op12_source_divergence", divergence.ORACLE)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(read_table(spark, sf_dir, "documents"))


@register("op13_url_filters")
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter_digest(read_table(spark, sf_dir, "pages"))
