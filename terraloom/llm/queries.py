"""The registered queries of this package and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraloom.llm import bpe_dp, conversation_trie, language_svm, license_minhash, line_frequency, pivotal_mix, secret_forest, simhash_vp, spotsigs, subword_quality, suffix_dedup, token_alignment, token_counts
from terraloom.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_pivotal_mix(spark, sf_dir):
    mixed = pivotal_mix.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query
def op6_bpe_prefix_dp(spark, sf_dir):
    return bpe_dp.digests(documents(spark, sf_dir))


@query
def op1_line_frequency(spark, sf_dir):
    return line_frequency.judge(documents(spark, sf_dir))


@query
def op3_simhash_vp(spark, sf_dir):
    return simhash_vp.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query
def op2_spotsigs(spark, sf_dir):
    return spotsigs.with_neighbours(documents(spark, sf_dir))


@query
def op4_language_svm(spark, sf_dir):
    return language_svm.identify(documents(spark, sf_dir))


@query
def op8_subword_quality(spark, sf_dir):
    return subword_quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op7_secret_forest(spark, sf_dir):
    return secret_forest.scan(documents(spark, sf_dir))


@query
def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(documents(spark, sf_dir))


@query
def op9_license_minhash(spark, sf_dir):
    return license_minhash.scan(documents(spark, sf_dir))


SQL["op9_license_minhash"] = license_minhash.oracle_sql()


@query
def op11_token_counts(spark, sf_dir):
    return token_counts.counts(documents(spark, sf_dir))


@query
def op13_token_alignment(spark, sf_dir):
    return token_alignment.align(documents(spark, sf_dir))


@query
def op12_conversation_trie(spark, sf_dir):
    return conversation_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL["op12_conversation_trie"] = conversation_trie.oracle_sql()
