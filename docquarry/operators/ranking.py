"""Gapless positions in a total order, without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.runtime import checkpointed, join_small

_LOW = (1 << 33) - 1


def positions(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """Adds q_pos (0-based place within its group), q_rows (rows of the group) and, given value, q_before and q_sum.

    The rows are range-partitioned by (group, order) and sorted, so a hot group spreads over many tasks. Each row's
    place in its partition is kept by a checkpoint; only one row per partition and group is then summed up to offsets.
    df: narrow rows, none of the group columns null. Ties in order get adjacent places. Empty input: no rows.
    q_before: the sum of value over the earlier rows of the group; q_sum: over all of the group.
    """
    keys = [*group, *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("q_id", F.monotonically_increasing_id())
    dealt = checkpointed(dealt).withColumn("q_part", F.shiftright("q_id", 33)).withColumn("q_row", F.col("q_id").bitwiseAND(F.lit(_LOW)))
    sums: list[Column] = [F.count(F.lit(1)).alias("q_n"), F.min("q_row").alias("q_first")]
    if value:
        sums.append(F.sum(value).alias("q_v"))
    parts = dealt.groupBy("q_part", *group).agg(*sums)
    over = Window.partitionBy(*group)
    before = over.orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("q_off", F.coalesce(F.sum("q_n").over(before), F.lit(0))).withColumn("q_rows", F.sum("q_n").over(over))
    if value:
        offsets = offsets.withColumn("q_voff", F.coalesce(F.sum("q_v").over(before), F.lit(0))).withColumn("q_sum", F.sum("q_v").over(over))
    offsets = checkpointed(offsets.drop("q_n", "q_v"))
    out = join_small(dealt, offsets, ["q_part", *group]).withColumn("q_pos", F.col("q_off") + F.col("q_row") - F.col("q_first"))
    if value:
        run = Window.partitionBy("q_part", *group).orderBy("q_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("q_before", F.col("q_voff") + F.coalesce(F.sum(value).over(run), F.lit(0))).drop("q_voff")
    return out.drop("q_id", "q_part", "q_row", "q_first", "q_off")
