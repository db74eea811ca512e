"""Queries over text and source corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import packing, prose, provenance, tokens
from codeloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_hand_written(table(spark, d, "files"), table(spark, d, "file_content"))


def p1_origins(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(table(spark, d, "files"), table(spark, d, "file_content"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "token_budgets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    budgets = table(spark, d, "token_budgets")
    return packing.fill(packing.pack_documents(table(spark, d, "documents"), budgets), budgets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return prose.not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return prose.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_origins, p6_ids, p7_containers, p7_fill, p8_found, p8_statistics)}


def oracle_sql() -> dict[str, str]:
    return {}
