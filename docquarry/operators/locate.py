"""Finding a named section in its document: a cascade of ever weaker matches, each on what the last one left, then of ever poorer texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.runtime import materialised, released

#: Characters that matching titles ignores, besides white space.
IGNORED = "　.,、:："
#: Length of the parts by which a title meets those that hold it.
_PART = 4


def title_key(title: Column) -> Column:
    return F.regexp_replace(title, rf"[\s{IGNORED}]+", "")


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit(True))


def held_pairs(short: DataFrame, long: DataFrame, by: str, held: str, holder: str) -> DataFrame:
    """Rows of short and long with equal `by` where holder contains held (not empty): they meet by held's first four characters, or by all of a shorter one, among holder's parts of that length.

    Parts are made only of the lengths that short has under the same `by`.
    """
    short = short.where(F.length(held) > 0).withColumn("q_part", F.left(held, F.lit(_PART)))
    sizes = short.groupBy(by).agg(F.collect_set(F.length("q_part")).alias("q_sizes"))
    none = F.array().cast("array<string>")
    parts = F.array_distinct(F.concat(*[F.when(F.array_contains("q_sizes", n), T.parts_of(F.col(holder), n)).otherwise(none) for n in range(1, _PART + 1)]))
    met = short.join(long.join(sizes, by).withColumn("q_part", F.explode(parts)).drop("q_sizes"), [by, "q_part"])
    return met.where(F.col(holder).contains(F.col(held))).drop("q_part")


def section_texts(sections: DataFrame, blocks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """doc_id, start, text: for each of the sections' starts, the blocks from the next one up to the following section's start, joined by line breaks.

    sections: doc_id, start; blocks: doc_id, pos, text. Empty blocks are left out, as is the block at the start itself. Only the
    starts in asked (doc_id, start) get a row, if it is given; blocks cross one shuffle, those of asked starts none after it.
    """
    mark = F.struct(F.col("pos").alias("start"), "asked")
    marks = sections.where("start IS NOT NULL").select("doc_id", F.col("start").alias("pos")).distinct()
    if asked is None:
        marks = marks.withColumn("asked", F.lit(True))
    else:
        wanted = asked.where("start IS NOT NULL").select("doc_id", F.col("start").alias("pos"), F.lit(True).alias("asked")).distinct()
        marks = marks.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").join(wanted, ["doc_id", "pos"], "left")
    marks = marks.select("doc_id", "pos", mark.alias("q_mark"))
    both = marks.withColumn("text", F.lit(None).cast("string")).unionByName(blocks.select("doc_id", "pos", "text"), allowMissingColumns=True)
    over = Window.partitionBy("doc_id").orderBy("pos", F.desc_nulls_last("q_mark.start")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = both.withColumn("q_own", F.last("q_mark", ignorenulls=True).over(over)).where("q_mark IS NULL AND q_own.asked AND pos > q_own.start AND text <> ''")
    listed = owned.groupBy("doc_id", F.col("q_own.start").alias("start")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return listed.select("doc_id", "start", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))


def kept(sections: DataFrame) -> DataFrame:
    """sections as a table in the shared folder, each row with a number of its own and whether it has content, so that resolve() can do without the contents until the end."""
    return materialised(sections.withColumns({"q_row": F.monotonically_increasing_id(), "q_full": ~blank(F.col("content"))}))


def resolve(located: DataFrame, sections: DataFrame, blocks: DataFrame, stands_alone: Column | None = None) -> DataFrame:
    """doc_id, ref, sec_id, title, content, found (id, exact, part), source (own, candidate, range, title) of each located section that has content.

    located: doc_id, ref (one row each), section_id, section_title. sections: doc_id, sec_id, ord, title, content, start
    (a block number or null). A section is found by its id (the last of equal ids), else by its exact title, else by one
    title holding the other without white space and punctuation; the first in order wins. Without content of its own it
    gives way to the first section of that title (exact, else part) that has some; then its blocks up to the next section are
    its content, then its title where stands_alone (an expression over title) says so. What is still empty is left out. Exact titles
    are looked for only where the id gave no content, parts of titles only where no exact one was found.

    The cascade runs on titles and numbers of sections (of kept(), which is called where sections don't come from it); contents are joined to
    what it chose, once, and blocks are read once, for the chosen sections without content.
    """
    if "q_row" not in sections.columns:
        sections = kept(sections)
    light = sections.select("doc_id", "sec_id", F.trim("title").alias("q_title"), F.struct("ord", "sec_id", "q_row", "q_full", "start").alias("q_x"))
    by_id = light.where("q_x.ord IS NOT NULL").groupBy("doc_id", F.col("sec_id").alias("section_id")).agg(F.max("q_x").alias("q_own"))
    first = located.join(by_id, ["doc_id", "section_id"], "left")
    left = first.where(F.col("q_own").isNull() | ~F.col("q_own.q_full")).select("doc_id", "ref", F.trim("section_title").alias("q_title"))
    offered = light.select("doc_id", title_key(F.col("q_title")).alias("q_key"), "q_x")
    best = lambda rows, found: rows.groupBy("doc_id", "ref").agg(F.min("q_x").alias("q_first"), F.min(F.when(F.col("q_x.q_full"), F.col("q_x"))).alias("q_filled")).withColumn("q_found", F.lit(found))
    exact = best(left.join(light, ["doc_id", "q_title"]), "exact")
    rest = left.join(exact, ["doc_id", "ref"], "left_anti").select("doc_id", "ref", title_key(F.col("q_title")).alias("q_wanted"))
    inside = held_pairs(rest, offered, "doc_id", "q_wanted", "q_key")
    around = held_pairs(offered, rest, "doc_id", "q_key", "q_wanted").select(*inside.columns)
    part = best(inside.unionByName(around), "part")
    out = first.join(exact.unionByName(part), ["doc_id", "ref"], "left").where("q_own IS NOT NULL OR q_first IS NOT NULL")
    out = out.withColumn("q_sec", F.coalesce("q_own", "q_first")).withColumn("q_found", F.when(F.col("q_own").isNotNull(), "id").otherwise(F.col("q_found")))
    gives_way = ~F.col("q_sec.q_full") & F.col("q_filled").isNotNull()
    out = out.withColumn("q_way", gives_way).withColumn("q_sec", F.when(gives_way, F.col("q_filled")).otherwise(F.col("q_sec")))
    chosen = materialised(out.select("doc_id", "ref", "q_sec.q_row", "q_sec.q_full", "q_sec.start", F.col("q_found").alias("found"), "q_way"))
    released(located.sparkSession)  # what the cascade shuffled isn't read again
    texts = section_texts(sections, blocks, chosen.where("NOT q_full"))
    ranged = chosen.join(texts.select("doc_id", "start", F.col("text").alias("q_range")), ["doc_id", "start"], "left").drop("q_full", "start")
    out = ranged.join(sections.select("q_row", "sec_id", "title", "content", "q_full"), "q_row")
    alone = F.coalesce(stands_alone, F.lit(False)) if stands_alone is not None else F.lit(False)
    source = F.when(F.col("q_way"), "candidate").when(F.col("q_full"), "own").when(~blank(F.col("q_range")), "range").when(alone & ~blank(F.col("title")), "title")
    content = F.when(F.col("source").isin("own", "candidate"), F.col("content")).when(F.col("source") == "range", F.col("q_range")).otherwise(F.col("title"))
    return out.withColumn("source", source).where("source IS NOT NULL").select("doc_id", "ref", "sec_id", "title", content.alias("content"), "found", "source")
