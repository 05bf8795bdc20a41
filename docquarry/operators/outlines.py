"""Outlines from flat rows: two levels by the groups of index tables, else by named parents and a stack of levels; numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import outline_key
from docquarry.operators.folds import place_in_outline
from docquarry.operators.trees import flatten
from docquarry.runtime import checkpointed

#: Cells that a row of an index table has at least, and those from which on a number may stand before its group.
CELLS, NUMBERED = 3, 4


def index_group(parent_name: Column, quote: Column, headers: tuple[str, ...] = ()) -> Column:
    """The group that a row of an index table belongs to: its parent's name, else the first cell of its quote, or the second behind a number; null for none, for
    numbers, and for header words (compared as keys)."""
    cells = F.transform(F.split(F.regexp_replace(F.coalesce(quote, F.lit("")), r"^[\s|]+|[\s|]+$", ""), "[|]"), lambda c: F.btrim(c))
    number = lambda c: c.rlike(r"^[0-9]+(?:[.][0-9]+)*[.、]?$")
    first, second = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
    cell = F.when(F.contains(quote, F.lit("|")) & (F.size(cells) >= CELLS), F.when(number(first) & (F.size(cells) >= NUMBERED), second).otherwise(first))
    fit = lambda c: F.when((outline_key(c) != "") & ~outline_key(c).isin([h.lower() for h in headers]), c)
    return F.coalesce(fit(F.btrim(F.coalesce(parent_name, F.lit("")))), F.when(~number(cell), fit(cell)))


def outline(rows: DataFrame, doc: str, pos: str, headers: tuple[str, ...] = ()) -> DataFrame:
    """doc, pos, number (dotted), parent (its number), name, kind (group or row) of the outline that rows (name, quote, level, parent_name, source_kind) make; pos is unique in a doc.

    Where a document's index-table rows name two groups or more, the outline is these groups, in order of their first rows, with their rows below them, each
    name once in a group; other rows are left out. Else each name counts once in the document, at its first row, and stands below the row that it names as
    its parent, wherever that is, else below the last row of a smaller level. Names and groups are compared by their outline keys; a row without a name takes its
    quote, one without both is left out. Named parents in a circle are an error. Rows without a doc are dropped.
    """
    name = F.coalesce(F.nullif(F.btrim("name"), F.lit("")), F.btrim("quote"))
    told = rows.where(F.col(doc).isNotNull()).select(
        F.col(doc).alias("d"), F.col(pos).cast("long").alias("n"), name.alias("name"), outline_key(name).alias("key"), F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)).cast("int").alias("level"),
        outline_key(F.coalesce("parent_name", F.lit(""))).alias("parent_key"), F.when(F.col("source_kind") == "index_table", index_group(F.col("parent_name"), F.col("quote"), headers)).alias("grp"),
    )
    held = told.where(F.col("grp").isNotNull() & (F.col("name") != "") & ~F.col("key").isin([h.lower() for h in headers])).withColumn("group_key", outline_key(F.col("grp")))
    groups = held.groupBy("d", "group_key").agg(F.min(F.struct("n", "grp")).alias("q"), F.max(F.col("key") != "").alias("full"))
    grouped = groups.groupBy("d").agg(F.count(F.lit(1)).alias("groups")).where("groups >= 2").select("d")
    node = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    heads = groups.where("full").join(grouped, "d", "left_semi").select("d", F.col("q.n").alias("n"), node("g", "group_key").alias("node"), F.lit(None).cast("string").alias("up"), F.col("q.grp").alias("name"), F.lit("group").alias("kind"))
    once = held.where("key <> ''").join(grouped, "d", "left_semi").groupBy("d", "group_key", "key").agg(F.min(F.struct("n", "name")).alias("q"))
    below = once.select("d", F.col("q.n").alias("n"), node("r", "q.n").alias("node"), node("g", "group_key").alias("up"), F.col("q.name").alias("name"), F.lit("row").alias("kind"))

    rest = told.where("key <> ''").join(grouped, "d", "left_anti").groupBy("d", "key").agg(F.min(F.struct("n", "name", "level", "parent_key")).alias("q")).select("d", "key", "q.*")
    placed = place_in_outline(rest, "d", "n", "level", "key", "parent_key").select("d", F.col("n").cast("long").alias("n"), "parent")
    stacked = rest.select("d", "n", "name").join(placed, ["d", "n"]).select("d", "n", node("r", "n").alias("node"), node("r", "parent").alias("up"), "name", F.lit("row").alias("kind"))

    nodes = heads.unionByName(below).unionByName(stacked)
    ordinal = F.row_number().over(Window.partitionBy("d", "up").orderBy("n", "node")).cast("string")
    of = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col("d").alias("d"), F.col(c).alias("x"))))
    # Read several times by the rounds of flatten(): made once.
    tree = flatten(checkpointed(nodes.select(of("node").alias("id"), of("up").alias("parent_id"), ordinal.alias("name"), "d", "n", "kind", F.col("name").alias("title"))))
    number = F.replace("path", F.lit(" / "), F.lit("."))
    return tree.select(F.col("d").alias(doc), F.col("n").alias(pos), number.alias("number"), F.nullif(F.regexp_replace(number, "[.]?[0-9]+$", ""), F.lit("")).alias("parent"), F.col("title").alias("name"), "kind")
