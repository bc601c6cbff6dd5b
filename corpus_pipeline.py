"""A training-corpus pipeline over ``documents``: each stage applies one operator to all that its predecessor kept.

In every stage an empty table gives none, and all but the last keep extra columns
whatever their names. What becomes of null, empty and repeated rows is said with
each stage; very long texts are treated whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, language, lines, mixing, near
from tessella.llm.text import WORD, free_names, store


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language can't be told (no letter, or no language with half of the text).

    Null and empty texts go; repeated rows are judged alike; a null id is judged as any other.
    """
    return language.keep_known(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later repeated runs of lines; a document of which no word is left goes, ``n_chars`` follows the text.

    Null and empty texts stay; rows of equal id and text are one document; a null id comes first.
    """
    (removed,) = free_names(docs, "n_removed")
    out = lines.dedup_lines(docs, removed=removed)
    changed = F.col(removed) > 0
    out = out.filter(~changed | F.col("text").rlike(WORD))
    return out.select(*(F.when(changed, F.char_length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies.

    Null texts and null ids stay; equal rows stay or go together.
    """
    return near.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item; null and empty texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken.

    A null text has size 0, so it isn't taken; a null source is a source of its own; equal rows are taken alike.
    """
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_near_copies),
    ("benchmark", without_benchmark),
    ("mixing", mixed),
]
#: SQL can't express language ID, near-dedup or tiling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
