"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskpanel.llm import (
    collocations, decontaminate, html_extract, language_id, lm_score, mixing, near_dedup, pii, quality, resampling, secret_scan, simhash,
    topk,
)
from riskpanel.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.language_model_scores(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_html": op1_html,
    "op2_near_dedup": op2_near_dedup,
    "op3_topk": op3_topk,
    "op4_decontamination": op4_decontamination,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_lm_score": op7_lm_score,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_collocations": op11_collocations,
    "op12_resampling": op12_resampling,
    "op13_simhash": op13_simhash,
}
ORACLES: dict[str, str] = {
    "op2_near_dedup": near_dedup.SQL,
    "op3_topk": topk.SQL,
    "op6_mixing": mixing.SQL,
    "op11_collocations": collocations.SQL,
    "op12_resampling": resampling.SQL,
}
