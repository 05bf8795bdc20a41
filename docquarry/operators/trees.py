"""Trees as adjacency rows: paths, descendants, subtrees, leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.runtime import checkpointed


def flatten(nodes: DataFrame, orphans: str = "error") -> DataFrame:
    """nodes: id (unique), parent_id (null: root), pos, name. Adds level, path (names joined by ' / '), ids, is_leaf, for trees of any depth.

    Each node knows a stretch of its ancestors and where the stretch ends, and each round joins the stretch that goes on from there, so
    stretches double and a tree of depth d takes log d joins. A parent that isn't there is an error, or with orphans="roots" none;
    parents in a circle are an error.
    """
    if orphans not in ("error", "roots"):
        raise ValueError("orphans: error or roots")
    there = nodes.select(F.col("id").alias("up")).withColumn("q_there", F.lit(True))
    state = nodes.select("id", F.col("parent_id").alias("up"), F.array("id").alias("ids"), F.array("name").alias("names")).join(there, "up", "left")
    if orphans == "error" and not state.where("up IS NOT NULL AND q_there IS NULL").isEmpty():
        raise ValueError("some parents are no nodes")
    state = checkpointed(state.select("id", F.when(F.col("q_there"), F.col("up")).alias("up"), "ids", "names"))
    while not (open_ := state.where("up IS NOT NULL")).isEmpty():
        if not open_.where(F.array_contains("ids", F.col("up"))).isEmpty():
            raise ValueError("some parents form a circle")
        next_ = state.select(F.col("id").alias("up"), F.col("up").alias("q_up"), F.col("ids").alias("q_ids"), F.col("names").alias("q_names"))
        longer = open_.join(next_, "up").select("id", F.col("q_up").alias("up"), F.concat("q_ids", "ids").alias("ids"), F.concat("q_names", "names").alias("names"))
        state = checkpointed(state.where("up IS NULL").unionByName(longer))
    inner = nodes.select(F.col("parent_id").alias("id")).where("id is not null").distinct()
    out = nodes.join(state.select("id", F.size("ids").alias("level"), F.array_join("names", " / ").alias("path"), "ids"), "id")
    return out.join(inner.withColumn("q_inner", F.lit(True)), "id", "left").withColumn("is_leaf", F.col("q_inner").isNull()).drop("q_inner")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent_id").alias("id")), "id", "left_anti")


def without_subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes without roots (id) and all below them."""
    gone = flatten(nodes).select("id", F.explode("ids").alias("q_up")).join(roots.select(F.col("id").alias("q_up")), "q_up", "left_semi").select("id").distinct()
    return nodes.join(gone, "id", "left_anti")
