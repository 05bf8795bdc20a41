"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import jaccard_join, mixture, packing, repetition, toxicity
from docquarry.runtime import removed, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep_good(docs)


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a model of this stage's own documents and the labels."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard_join.keep_first(docs, n=5, num=80, den=100)


def mixture_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix draws them."""
    return mixture.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows; a document that was drawn k times gives its pieces k times."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("toxicity", civility), ("n-gram jaccard join", distinct), ("mixing", mixture_of_sources), ("packing", packed),
]
#: Models and exact set similarity have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; each stage's rows are written and read again in the shared checkpoint folder.

    A stage's table goes once its successor's is written whole, or, for the last, once packing has checkpointed the pieces. Null ids and
    repeated rows are documents of their own in every stage; null texts fail the quality rules; an empty table gives no rows.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if last:
            removed(spark, last)
        last = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    removed(spark, last)
    return out
