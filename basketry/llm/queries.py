"""The operators over their whole tables, as registered queries, and DuckDB texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import brown, chat, decontaminate, licenses, mixing, periodic_runs, quality, simhash, substrings, suffix_dedup, tokens, url_filters, vector_codes
from basketry.llm.common import read, stored

Query = Callable[[SparkSession, str], DataFrame]


def op1_brown_lm(spark: SparkSession, folder: str) -> DataFrame:
    return brown.scores(read(spark, folder, "documents"))


def op2_url_list_asof(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    return url_filters.evaluate(url_filters.derived_captures(pages), url_filters.derived_entries(pages))


def op3_license_patience(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(spark, folder, "documents"))


def op4_simhash_balls(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op5_pivotal_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"))


def op6_elias_fano(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(read(spark, folder, "documents"))


def op7_fm_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicated(read(spark, folder, "documents"))


def op8_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op9_adaptive_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(read(spark, folder, "documents"))


def op10_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").unionByName(chat.probe(spark), allowMissingColumns=True)
    return chat.read_back(stored(chat.samples(turns), "chat-samples"))


def op11_anchor_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.encoded(read(spark, folder, "embeddings"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.detected(read(spark, folder, "documents"), planted=True)


def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicated(read(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_brown_lm, op2_url_list_asof, op3_license_patience, op4_simhash_balls, op5_pivotal_mix, op6_elias_fano, op7_fm_substrings,
        op8_template_decontamination, op9_adaptive_quality, op10_chat_windows, op11_anchor_codes, op12_periodic_runs, op13_suffix_dedup,
    )
}
ORACLES: dict[str, str] = {"op2_url_list_asof": url_filters.ORACLE, "op11_anchor_codes": vector_codes.ORACLE}
