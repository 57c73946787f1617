"""A corpus pipeline of five stages; each writes Parquet that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trendspark.llm import decontaminate, language_id, simhash_dedup, source_mixing, token_output
from trendspark.session import materialize


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that the labelled ones teach: not those without a letter, nor noise."""
    return language_id.accepted(docs, language_id.fit(language_id.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash group."""
    return simhash_dedup.dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of whose words at least a twentieth lie in a window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws each document with the rate, of at most one, that mixes the domains of `labels` to their target shares."""
    labels = source_mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return source_mixing.draw(docs, source_mixing.fit_domains(docs, labels), source_mixing.DRAW_TARGETS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards, and returns what reading them back gives for each document."""
    return token_output.token_digest(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("simhash_dedup", near_duplicates),
    ("decontaminate", decontaminated),
    ("source_mixing", mixed),
    ("token_output", tokens),
]

#: Models and hash joins decide here, which SQL can't express; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
