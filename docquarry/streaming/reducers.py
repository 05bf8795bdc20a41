"""State shared by many writers, reduced from their updates: the same plan over a table and, in update mode, over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduced(updates: DataFrame, key: str, at: str, event: str, fields: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """key, fields, lists: for each field the value of the latest update that has one, for each list the items of all updates in order.

    Updates are ordered by at (null first), then event; where both tie, the greater value wins a field. A repeated update (equal in all of these) counts once,
    and a late one finds its place, so the order of arrival doesn't matter. A null field or list is one that the update doesn't touch. In a stream
    the state of a key holds its lists, as its result does.
    """
    told = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("a"), F.col(event).alias("e"), F.col(c).alias("v")))
    last = [F.max(told(f)).getField("v").alias(f) for f in fields]
    listed = [F.flatten(F.transform(F.array_sort(F.collect_set(told(x))), lambda u: u["v"])).alias(x) for x in lists]
    return updates.groupBy(key).agg(*last, *listed)
