"""Blocks to sections: heading stacks, numbering, spans and runs, as window expressions over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 4


def parents(rows: DataFrame, doc: str = "doc_id", pos: str = "pos", level: str = "level") -> DataFrame:
    """Adds parent_pos: the most recent earlier heading of a smaller level; for body rows (level 0) the most recent heading.

    The most recent heading of any smaller level is what a stack would hold on top, so no fold is needed.
    """
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == k, F.col(pos)), ignorenulls=True).over(before) for k in range(1, LEVELS + 1)]
    of = F.when(F.col(level) == 1, F.lit(None).cast("long"))
    for k in range(2, LEVELS + 1):
        of = of.when(F.col(level) == k, F.greatest(*last[: k - 1]) if k > 2 else last[0])
    return rows.withColumn("parent_pos", of.otherwise(F.greatest(*last)))


def chapter_ids(rows: DataFrame, doc: str = "doc_id", pos: str = "pos", level: str = "level", levels: int = LEVELS) -> DataFrame:
    """Adds chapter_id of heading rows: counters per level, deeper ones reset, skipped shallower ones counted as 1.

    A level's counter is its running count since the last smaller heading; a skipped level that a deeper heading opened starts at 1.
    """
    upto = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for j in range(1, levels + 1):
        out = out.withColumn(f"q_e{j}", F.sum(F.when((F.col(level) >= 1) & (F.col(level) < j), 1).otherwise(0)).over(upto))
    for j in range(1, levels + 1):
        own = Window.partitionBy(doc, f"q_e{j}").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        first_own = F.min(F.when(F.col(level) == j, F.col(pos))).over(own)
        first_deep = F.min(F.when(F.col(level) > j, F.col(pos))).over(own)
        opened = F.when(first_deep.isNotNull() & (first_own.isNull() | (first_deep < first_own)), 1).otherwise(0)
        out = out.withColumn(f"q_c{j}", F.sum(F.when(F.col(level) == j, 1).otherwise(0)).over(own) + opened)
    name = F.when(F.col(level) == 1, F.col("q_c1").cast("string"))
    for k in range(2, levels + 1):
        name = name.when(F.col(level) == k, F.concat_ws(".", *[F.col(f"q_c{j}").cast("string") for j in range(1, k + 1)]))
    return out.withColumn("chapter_id", name).drop(*[f"q_{x}{j}" for x in "ec" for j in range(1, levels + 1)])


def ends(rows: DataFrame, doc: str = "doc_id", pos: str = "pos", level: str = "level") -> DataFrame:
    """Adds end_pos of heading rows: the position of the next heading of the same or a smaller level, else the document's last plus 1."""
    after = Window.partitionBy(doc).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(doc)
    of = F.when(F.col(level) == 0, F.lit(None).cast("long"))
    for k in range(1, LEVELS + 1):
        of = of.when(F.col(level) == k, F.coalesce(F.min(F.when(F.col(level).between(1, k), F.col(pos))).over(after), F.max(pos).over(whole) + 1))
    return rows.withColumn("end_pos", of)


def runs(rows: DataFrame, flag: str, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Adds run_id to rows where flag holds: consecutive ones share it (gaps and islands)."""
    w = Window.partitionBy(doc).orderBy(pos)
    return rows.withColumn("run_id", F.when(F.col(flag), F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w)))
