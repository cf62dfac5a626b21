"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All stages but the last return the columns of
``documents``; a stage's result is written as Parquet in the session's shared checkpoint folder and read again as the next one's input.
Null texts and ids, empty tables and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraloom.llm import bpe_dp, line_frequency, pivotal_mix, secret_forest, simhash_vp
from terraloom.llm.common import documents, save

#: SQL has no fingerprints by XXH64 bits, forests, pivotal draws or byte-pair merges; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines that are too frequent on their host go from the others."""
    return line_frequency.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_vp.first_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secret_forest.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document appears as often as its source's target takes it, or not at all."""
    return pivotal_mix.apply_mix(docs)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded text."""
    return bpe_dp.encode(docs)


STAGES = [
    ("quality rules", quality_rules), ("near dedup", near_dedup), ("secret scan", secret_scan), ("source mix", source_mix), ("byte pairs", byte_pairs),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs
