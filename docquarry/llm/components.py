"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.runtime import released, removed, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). Returns id, component for every node of an edge; component is its smallest reachable id.

    Both rounds group by a node with a minimum only, which is pre-aggregated, and join it back; no neighbour list is
    gathered, so a hub of any degree splits like any skewed join. Rounds grow with the logarithm of the longest path.
    Loops and repeated edges do no harm; null ends are dropped; no edges give no rows. The result is a table in the shared folder;
    a round's tables go with it. Small ones are read back in few pieces, so that rounds on few edges are few tasks and files.
    """
    spark = edges.sparkSession
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, path = stored(e)
    before = None
    while (now := _state(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, middle = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e, after = stored(small.distinct())
        removed(spark, path), removed(spark, middle)
        path = after
        released(spark)  # a round's shuffles go with it
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out, _ = stored(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(roots))
    removed(spark, path)
    return out
