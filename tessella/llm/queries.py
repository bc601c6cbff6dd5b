"""Registered queries of the corpus operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language, licenses, lines, mixing, near, pages, perplexity, scoring, substrings


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


QUERIES = {
    "op1_perplexity": lambda spark, d: perplexity.quality_rules(documents(spark, d)),
    "op2_lm_score": lambda spark, d: scoring.lm_score(documents(spark, d)),
    "op3_mixing": lambda spark, d: mixing.mix(documents(spark, d)),
    "op4_html_text": lambda spark, d: pages.extract(spark.read.parquet(f"{d}/pages.parquet")),
    "op5_language": lambda spark, d: language.identify(documents(spark, d)),
    "op6_licenses": lambda spark, d: licenses.report(documents(spark, d)),
    "op7_near_duplicates": lambda spark, d: near.classes(documents(spark, d)),
    "op8_decontamination": lambda spark, d: decontaminate.report(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op9_substrings": lambda spark, d: substrings.report(documents(spark, d)),
    "op10_line_dedup": lambda spark, d: lines.report(documents(spark, d)),
}
ORACLE: dict[str, str] = {"op3_mixing": mixing.SQL}
