"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import chat, hilbert, jaccard_join, lexical, linededup, lm_scores, mixture, packing, repetition, runs, spotsigs, tokencount, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.document_shards(table(spark, sf_dir, "documents"))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixed_sizes(table(spark, sf_dir, "documents"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_classes(table(spark, sf_dir, "documents"))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.coverage(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_hostile(table(spark, sf_dir, "conversations")))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.lm_scores(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hilbert_shards, op2_mixture, op3_spotsigs, op4_jaccard_join, op5_repetition, op6_chat_format, op7_lm_scores, op8_packing, op9_token_counts, op10_toxicity, op11_lexical_search, op12_line_dedup, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op2_mixture": mixture.ORACLE, "op4_jaccard_join": jaccard_join.ORACLE, "op5_repetition": repetition.ORACLE, "op6_chat_format": chat.ORACLE, "op11_lexical_search": lexical.ORACLE, "op12_line_dedup": linededup.ORACLE}
