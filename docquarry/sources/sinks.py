"""Sinks: partitioned tables, JSON lines, and Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Overwrites only the partitions that rows has; others stay."""
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def markdown(sections: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """doc, text: its sections (level, title, content) in order as Markdown; one document must fit in a task."""
    part = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), part.alias("t"))))
    return sections.groupBy(doc).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("text"))
