"""Keyed unions and dedupes with a stated winner, whatever order rows arrive in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Of each key's rows the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("q_n", F.row_number().over(w)).where("q_n = 1").drop("q_n")


def union_left_wins(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left, and right's rows with keys that left lacks."""
    return left.unionByName(right.join(left.select(*keys).distinct(), list(keys), "left_anti").select(*left.columns))


def last_wins(rows: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """A row per key: the last one's values at the first one's position."""
    w = Window.partitionBy(*keys)
    return first_by(rows.withColumn("q_first", F.min(pos).over(w)), keys, [F.desc(pos)]).withColumn(pos, F.col("q_first")).drop("q_first")


def existing_wins(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer merge by key: old's value unless it is blank."""
    o = old.select(key, F.col(value).alias("q_old"))
    return new.join(o, key, "full_outer").select(key, F.coalesce(F.nullif(F.trim("q_old"), F.lit("")), F.col(value)).alias(value))


def conflicts(facts: DataFrame, key: str, value: str, pos: str, most: int = 8) -> DataFrame:
    """Keys with several distinct values: key, values (sorted), occurrences (the first ones' positions; only so many are gathered)."""
    some = facts.groupBy(key).agg(F.sort_array(F.collect_set(F.col(value).cast("string"))).alias("values")).where(F.size("values") > 1)
    early = facts.withColumn("q_n", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where(F.col("q_n") <= most)
    return some.join(early.groupBy(key).agg(F.sort_array(F.collect_list(pos)).alias("occurrences")), key)


def single_owner(scored: DataFrame, node: str, item: str, score: str) -> DataFrame:
    """node, item: each item on the node with its best score, the smaller node if several have it; nodes left without any get a row with a null item.

    One row per item survives a pre-aggregated maximum, so an item that every node is assigned makes no hot task.
    """
    best = scored.groupBy(item).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(node)).alias("n"))).alias("q_best"))
    kept = best.select((-F.col("q_best.n")).alias(node), item)
    empty = scored.select(node).distinct().join(kept.select(node).distinct(), node, "left_anti")
    return kept.unionByName(empty.withColumn(item, F.lit(None).cast(scored.schema[item].dataType)))
