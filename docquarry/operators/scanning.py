"""Blocks of office documents to section rows, and the text of block ranges: a reading by styles with a second one by numbers, spans, counts, running cuts.

Blocks are (doc, pos, kind, text, style, outline, images, graphics); pos numbers a document's blocks from 0 without gaps. Documents never meet, and
a document's blocks are put in order inside one task (running windows, which spill).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.sections import chapter_ids

#: Levels that styles can name, headings of lists of contents, and the title of a heading that is a number only.
LEVELS, CONTENTS, UNNAMED = 9, ("目录", "目 录"), "未命名章节"
#: Explicit headings from which on numbered lines are no headings, their length at most, and their deepest level.
ENOUGH, SHORT, DEEPEST = 3, 80, 4
_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _EDGES, "")


def explicit_level(style: Column, outline: Column) -> Column:
    """Level by style name or outline level (from 0): 0 for entries of contents and impossible levels, null where neither tells."""
    s = F.lower(stripped(style))
    named = F.coalesce(*[F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in (r"(?:^|\s)heading\s*([0-9]{1,9})\b", r"(?:标题|標題)\s*([0-9]{1,9})")]).cast("int")
    return (
        F.when(s.startswith("toc") | s.rlike("目录|目錄"), 0).when(named.isNotNull(), F.when(named.between(1, LEVELS), named).otherwise(0))
        .when(outline.between(0, LEVELS - 1), outline.cast("int") + 1)
    )


def numbered_level(text: Column) -> Column:
    """Level by the number that a short line begins with, else 0."""
    number = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)*)(?:[.、]\s*|\s+)", 1)
    return F.when((number == "") | (F.length(text) > SHORT), 0).otherwise(F.least(F.size(F.split(number, "[.]")), F.lit(DEEPEST)))


def section_scan(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """A row for each heading: doc, pos, chapter_id, title, full_path, level, start_block (from 1), end_block (where the next heading of its or
    a smaller level stands, else the number of blocks), image_count, table_count, graphic_count over the section with its subsections.

    Paragraphs are headings by style or outline level; where a document has fewer than three of these, short numbered paragraphs are, too.
    Null texts, blank ones and headings of contents are none; a document without headings gives no row.
    """
    whole, text = Window.partitionBy(doc), stripped(F.col("text"))
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    paragraph = (F.col("kind") == "paragraph") & (text != "")
    tally = F.struct(
        F.coalesce("images", F.lit(0)).cast("long").alias("images"), (F.col("kind") == "table").cast("long").alias("tables"), F.coalesce("graphics", F.lit(0)).cast("long").alias("graphics")
    )
    rows = blocks.select(doc, pos, text.alias("text"), F.when(paragraph, explicit_level(F.col("style"), F.col("outline"))).otherwise(0).alias("own"), tally.alias("n"))
    sums = lambda w: F.struct(*[F.coalesce(F.sum(f"n.{x}").over(w), F.lit(0)).alias(x) for x in ("images", "tables", "graphics")])
    rows = rows.withColumns({"so_far": sums(before), "all": sums(whole), "blocks": F.max(pos).over(whole) + 1, "explicit": F.count_if(F.col("own") > 0).over(whole)})
    level = F.coalesce("own", F.when(F.col("explicit") < ENOUGH, numbered_level(F.col("text"))).otherwise(0))
    heads = rows.withColumn("level", level).where((F.col("level") > 0) & ~F.col("text").isin(*CONTENTS))
    bare = stripped(F.regexp_replace("text", r"^[0-9]+(?:\.[0-9]+)*[.、\s]+", ""))
    heads = heads.withColumn("title", F.when(bare == "", UNNAMED).otherwise(bare))

    # The stack, without a fold: a level's last heading is open if it stands behind the last headings of all smaller levels.
    last = [F.last(F.when(F.col("level") == j, F.struct(F.col(pos).alias("p"), F.col("title").alias("t"))), ignorenulls=True).over(before) for j in range(1, LEVELS)]
    heads = heads.withColumn("open", F.array(*last))
    later = lambda x, j: F.forall(F.slice(F.col("open"), 1, j), lambda y: y.isNull() | (y["p"] < x["p"]))
    above = F.filter(F.col("open"), lambda x, j: x.isNotNull() & (j + 1 < F.col("level")) & later(x, j))
    path = F.array_join(F.concat(F.transform(above, lambda x: x["t"]), F.array("title")), "/")

    after = Window.partitionBy(doc).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    end = None
    for k in range(1, LEVELS + 1):
        is_k, closes = F.col("level") == k, F.first(F.when(F.col("level") <= k, F.struct(F.col(pos).alias("p"), F.col("so_far").alias("s"))), ignorenulls=True).over(after)
        end = F.when(is_k, closes) if end is None else end.when(is_k, closes)
    heads = heads.withColumn("full_path", path).withColumn("end", F.coalesce(end, F.struct(F.col("blocks").alias("p"), F.col("all").alias("s"))))
    count = lambda x: (F.col(f"end.s.{x}") - F.col(f"so_far.{x}"))
    return chapter_ids(heads, doc, pos, "level", LEVELS).select(
        doc, pos, "chapter_id", "title", "full_path", "level", (F.col(pos) + 1).alias("start_block"), F.col("end.p").alias("end_block"),
        count("images").alias("image_count"), count("tables").alias("table_count"), count("graphics").alias("graphic_count"),
    )


def range_text(ranges: DataFrame, blocks: DataFrame, key: str, doc: str = "doc_id", pos: str = "pos", start: str = "start_block", end: str = "end_block", most: int = 6000) -> DataFrame:
    """key, content: the texts of the blocks from start (from 1) to end, each stripped, joined by line feeds until their lengths reach `most`, and cut there.

    A range whose ends are null, or that holds no text, gives an empty content. Blocks and ranges meet by stretches of `most` characters of a
    document, of which a range needs its first and the next, so that a document's ranges are never compared with all its blocks.
    """
    told = blocks.select(F.col(doc).alias("q_doc"), F.col(pos).alias("q_pos"), stripped(F.col("text")).alias("q_text")).withColumns({"q_n": F.length("q_text")})
    before = Window.partitionBy("q_doc").orderBy("q_pos").rowsBetween(Window.unboundedPreceding, -1)
    told = told.select("q_doc", "q_pos", F.left("q_text", F.lit(most)).alias("q_text"), F.coalesce(F.sum("q_n").over(before), F.lit(0)).alias("q_before"))
    asked = ranges.select(F.col(key).alias("q_key"), F.col(doc).alias("q_of"), (F.greatest(F.col(start), F.lit(1)) - 1).alias("q_from"), F.col(end).alias("q_to")).where("q_from IS NOT NULL AND q_to IS NOT NULL")
    based = asked.join(told.select("q_doc", "q_pos", F.col("q_before").alias("q_base")), (F.col("q_of") == F.col("q_doc")) & (F.col("q_from") == F.col("q_pos"))).drop("q_doc", "q_pos")
    near = based.withColumn("q_part", F.explode(F.array(F.floor(F.col("q_base") / most), F.floor(F.col("q_base") / most) + 1)))
    parts = told.where("q_text <> ''").withColumn("q_cell", F.floor(F.col("q_before") / most))
    held = near.join(parts, (F.col("q_of") == F.col("q_doc")) & (F.col("q_part") == F.col("q_cell"))).where((F.col("q_pos") >= F.col("q_from")) & (F.col("q_pos") < F.col("q_to")) & (F.col("q_before") - F.col("q_base") < most))
    listed = held.groupBy("q_key").agg(F.array_sort(F.collect_list(F.struct("q_pos", "q_text"))).alias("q_x"))
    joined = F.left(F.array_join(F.transform("q_x", lambda x: x["q_text"]), "\n"), F.lit(most))
    out = ranges.select(key).join(listed.select("q_key", joined.alias("content")), F.col(key) == F.col("q_key"), "left")
    return out.select(key, F.coalesce("content", F.lit("")).alias("content"))


def assembled(nodes: DataFrame, node: str, parent: str, order: str, title: str = "title", content: str = "content") -> DataFrame:
    """node, text: each node's own content, then its children's titles (##) and contents in order, each followed by its children's (###); deeper ones stay out.

    Empty and null titles and contents give no line. Orders that tie are told apart by node, repeated nodes by their text.
    """
    at = F.struct(F.col(order).alias("o"), F.col(node).alias("n"))
    rows = nodes.select(F.col(node).alias("q_node"), F.col(parent).alias("q_parent"), at.alias("q_at"), F.nullif(F.coalesce(title, F.lit("")), F.lit("")).alias("q_title"), F.nullif(F.coalesce(content, F.lit("")), F.lit("")).alias("q_text"))
    up = rows.select(F.col("q_node").alias("q_mid"), F.col("q_parent").alias("q_top"), F.col("q_at").alias("q_mid_at")).where("q_top IS NOT NULL")
    part = lambda mark: F.concat_ws("\n", F.concat(F.lit(f"\n{mark} "), F.col("q_title")), F.col("q_text"))
    own = rows.select("q_node", F.array().cast(rows.select(F.array("q_at").alias("a")).schema["a"].dataType).alias("q_places"), F.col("q_text").alias("q_part"))
    children = rows.where("q_parent IS NOT NULL").select(F.col("q_parent").alias("q_node"), F.array("q_at").alias("q_places"), part("##").alias("q_part"))
    below = rows.join(up, F.col("q_parent") == F.col("q_mid")).select(F.col("q_top").alias("q_node"), F.array("q_mid_at", "q_at").alias("q_places"), part("###").alias("q_part"))
    listed = own.union(children).union(below).groupBy("q_node").agg(F.array_sort(F.collect_list(F.when(F.col("q_part") != "", F.struct("q_places", "q_part")))).alias("q_x"))
    return listed.join(rows.select(F.col("q_node").alias("q_is")), F.col("q_node") == F.col("q_is"), "left_semi").select(F.col("q_node").alias(node), F.array_join(F.transform("q_x", lambda x: x["q_part"]), "\n").alias("text"))
