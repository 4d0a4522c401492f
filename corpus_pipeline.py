"""A training corpus out of ``documents``: stages that each write their rows before the next reads them.

Each stage takes what the one before kept, with the columns of ``documents`` (the last adds its own). Null
and empty texts, null ids, repeated rows and further columns are treated as the stage's operator says;
empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskpanel.llm import decontaminate, mixing, near_dedup, quality, secret_scan
from riskpanel.llm.common import table
from riskpanel.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from their own labels."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and ``n_chars`` brought up to date."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: its documents, texts included, and the words to take of each; the others go."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("mixing sources", mix),
]

#: A fitted classifier decides in the first stage, which SQL cannot express; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
