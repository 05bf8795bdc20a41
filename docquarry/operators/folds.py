"""Rules that depend on all rows before (folds per document), numbering of appended rows, and roll-ups over dotted numbers.

A fold reads a document's rows in order and keeps its state only, so that a document of any length takes linear time and no list of its rows is
held; rows of different documents never meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docquarry.runtime import ship

LEVELS = 4


def folded(rows: DataFrame, doc: str, order: list[str], begin: Callable[[], dict], step: Callable[[dict, dict], dict | list | None], out: str) -> DataFrame:
    """doc and the columns out: what step(state, row) gives for the rows of a document in order; None gives no row, a list one for each of its items. step changes the state that begin made.

    Rows go to their document's partition and are sorted there, on disk if need be; a task passes over them once. Rows with a null doc are one document;
    rows that tie in order may come in any order.
    """
    ship(rows.sparkSession)
    schema = StructType([rows.schema[doc], *StructType.fromDDL(out).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, fresh = None, None, True
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if fresh or row[doc] != now:
                    state, now, fresh = begin(), row[doc], False
                told = step(state, row)
                for x in told if isinstance(told, list) else [] if told is None else [told]:
                    made.append({doc: now, **x})
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return rows.repartition(doc).sortWithinPartitions(doc, *order).mapInArrow(run, schema)


def _place(state: dict, r: dict) -> dict:
    own, parent = r["q_level"], r["q_at"]
    if parent is None:
        above = max((k for k in state if k < (own or 1)), default=None)
        parent, own = (None, 1) if above is None else (state[above], own)
    if own is not None:
        for k in [k for k in state if k >= own]:
            del state[k]
        if own >= 1:
            state[own] = r["n"]
    return {"n": r["n"], "parent": parent, "level": own}


def place_in_outline(rows: DataFrame, doc: str, pos: str, level: str, name: str, parent_name: str) -> DataFrame:
    """doc, pos (n), parent, level of each row: below the row that it names, wherever that stands and if it isn't itself, else below the
    last row of the nearest smaller level that is still open, else a root, whose level becomes 1. A null level is open to none."""
    named = rows.groupBy(doc, F.col(name).alias(parent_name)).agg(F.min(pos).alias("q_at"))
    found = rows.join(named, [doc, parent_name], "left").withColumn("q_at", F.when(F.col("q_at") != F.col(pos), F.col("q_at")))
    told = found.select(doc, F.col(pos).cast("int").alias("n"), F.col(level).cast("int").alias("q_level"), F.col("q_at").cast("int").alias("q_at"))
    return folded(told, doc, ["n", "q_level", "q_at"], dict, _place, "n int, parent int, level int")


def _smooth(last: dict, r: dict) -> dict:
    path, level = r["q_path"].split(".") if r["q_path"] else [], r["q_level"]
    k = len(path)
    if k and (level or 0) > 0 and (k == 1 or k not in last or k - 1 in last or last[k][:-1] == path[:-1]):
        for j in [j for j in last if j > k]:
            del last[j]
        last[k] = path
        level = 2 if k == 1 else min(k, LEVELS)
    return {"n": r["n"], "level": level}


def smooth_levels(rows: DataFrame, doc: str, pos: str, text: str, level: str) -> DataFrame:
    """doc, pos (n), level: headings (level above 0) whose number carries on from the last ones take its level: 2 for one part, else the number of parts, 4 at most.

    A number carries on if it has one part, if its depth was not met or the one above was met since the last smaller one, or if it shares all
    but its last part with the last number of its depth. Null levels stay null.
    """
    path = F.regexp_extract(F.coalesce(text, F.lit("")), "^([0-9]+(?:[.][0-9]+)*)[.、 ]", 1)
    told = rows.select(doc, F.col(pos).cast("int").alias("n"), F.col(level).cast("int").alias("q_level"), path.alias("q_path"))
    return folded(told, doc, ["n", "q_level", "q_path"], dict, _smooth, "n int, level int")


def batched(rows: DataFrame, doc: str, order: str, size: str, most: int) -> DataFrame:
    """doc, order, batch (from 0): rows dealt to batches in order; a batch closes when the next row would pass `most`, so a larger row is a batch of its own.

    Null sizes count as 0; rows that tie in order come by size.
    """

    def step(state: dict, r: dict) -> dict:
        n = r["q_n"] or 0
        over = state["size"] > 0 and state["size"] + n > most
        state["batch"] += over
        state["size"] = n + (0 if over else state["size"])
        return {order: r[order], "batch": state["batch"]}

    told = rows.select(doc, order, F.col(size).cast("long").alias("q_n"))
    return folded(told, doc, [order, "q_n"], lambda: {"size": 0, "batch": 0}, step, f"`{order}` {rows.schema[order].dataType.simpleString()}, batch int")


def within_budget(rows: DataFrame, doc: str, order: list[str], key: str, size: str, most: int) -> DataFrame:
    """doc, key of the rows that are taken in order while they fit into what is left of `most`; the first is always taken. Null sizes count as 0."""

    def step(state: dict, r: dict) -> dict | None:
        n = r[size] or 0
        if state and state["size"] + n > most:
            return None
        state["size"] = state.get("size", 0) + n
        return {key: r[key]}

    return folded(rows.select(doc, *dict.fromkeys([*order, key, size])), doc, order, dict, step, f"`{key}` {rows.schema[key].dataType.simpleString()}")


def unrepeated(rows: DataFrame, doc: str, pos: str, text: str, shortest: int = 6) -> DataFrame:
    """doc, pos of the texts that don't repeat the last one kept, whole or, from `shortest` characters on, as a part of it. Null texts are dropped."""

    def step(state: dict, r: dict) -> dict | None:
        t, last = r["q_text"], state.get("last")
        if last is not None and (t == last or (len(t) >= shortest and t in last)):
            return None
        state["last"] = t
        return {pos: r[pos]}

    told = rows.select(doc, pos, F.col(text).alias("q_text")).where("q_text IS NOT NULL")
    return folded(told, doc, [pos, "q_text"], dict, step, f"`{pos}` {rows.schema[pos].dataType.simpleString()}")


def appended(rows: DataFrame, last: DataFrame, parent: str, order: str, number: str) -> DataFrame:
    """rows with chapter_id: their parent's, and the next numbers behind its last one."""
    placed = rows.join(last, parent, "left").withColumn("q_n", F.row_number().over(Window.partitionBy(parent).orderBy(order)))
    return placed.withColumn("chapter_id", F.concat_ws(".", parent, (F.coalesce(number, F.lit(0)) + F.col("q_n")).cast("string"))).drop("q_n")


def rolled_up(tree: DataFrame, sums: DataFrame) -> DataFrame:
    """tree with n and total of its own node, and below_n and below_total of all nodes below. sums: node (a dotted number), n, total.

    Each sum is added at every number above its own, so no tree is walked and partial sums come before the shuffle.
    """
    parts = F.split("node", "[.]")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), ".")))
    below = sums.where(F.size(parts) > 1).select(up.alias("chapter_id"), "n", "total").groupBy("chapter_id").agg(F.sum("n").alias("below_n"), F.sum("total").alias("below_total"))
    return tree.join(sums.withColumnRenamed("node", "chapter_id"), "chapter_id", "left").join(below, "chapter_id", "left")
