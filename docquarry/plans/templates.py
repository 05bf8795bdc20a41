"""Sections and templates found in documents' lines; each counterpart is written on its own from the rule.

A line of at most 60 characters that isn't blank is a heading; lines of 120 characters and more are its section's content, and
all lines up to the next heading its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import locate, similar
from docquarry.operators import sections as S
from docquarry.plans.query import Catalog, table
from docquarry.runtime import materialised, released
from docquarry.sources.readers import lines

Q = Catalog()
_HEADING, _CONTENT = 60, 120

_LINES = """
l AS (SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""


def _is_heading(line: Column) -> Column:
    return F.length(F.trim(line)).between(1, _HEADING)


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, line, heading, start (of the section that the line is in; null before the first heading)."""
    return with_starts(lines(table(spark, sf_dir, "documents")))


def with_starts(rows: DataFrame) -> DataFrame:
    """numbered_lines() of lines, of which those that are no headings may be left out."""
    rows = rows.withColumn("pos", F.col("pos").cast("long")).withColumn("heading", _is_heading(F.col("line")))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("start", F.max(F.when(F.col("heading"), F.col("pos"))).over(upto))


def line_sections(rows: DataFrame) -> DataFrame:
    """doc_id, sec_id, ord, title, content, start of numbered_lines(): every third section (by start) has no start of its own."""
    long = F.when(~F.col("heading") & (F.length("line") >= _CONTENT), F.struct("pos", "line"))
    made = rows.where("start IS NOT NULL").groupBy("doc_id", "start").agg(F.max(F.when(F.col("heading"), F.col("line"))).alias("title"), F.array_sort(F.collect_list(long)).alias("x"))
    content = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    return made.select("doc_id", F.concat(F.lit("s"), F.col("start").cast("string")).alias("sec_id"), F.col("start").alias("ord"), "title", content.alias("content"), F.when(F.col("start") % 7 != 6, F.col("start")).alias("start"))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a heading."""
    return table(spark, sf_dir, "documents").where(F.exists(F.split("text", "\n"), _is_heading))


def asked_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sections of documents' lines, kept for resolve(), and the lines as blocks, of headed() documents only: the others have no section."""
    docs = headed(spark, sf_dir)
    needed = with_starts(lines(docs).where(_is_heading(F.col("line")) | (F.length("line") >= _CONTENT)))
    sections = locate.kept(line_sections(needed))
    released(spark)  # the lines that were shuffled for the sections
    return sections, lines(docs).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("line").alias("text"))


def asked_sections(sections: DataFrame) -> DataFrame:
    """References to sections as a reader would give them: by id, by title, by a part of it, with words around it, or by a title that isn't there."""
    kind = (F.col("doc_id") + F.col("ord")) % 5
    title = F.when(kind == 1, F.concat(F.lit(" "), "title", F.lit("  "))).when(kind == 2, F.left("title", F.length("title") - 4)).when(kind == 3, F.concat("title", F.lit(": continued"))).when(kind == 4, F.lit("nothing of that name")).otherwise(F.col("title"))
    return sections.select("doc_id", F.col("ord").alias("ref"), F.when(kind == 0, F.col("sec_id")).otherwise("?").alias("section_id"), title.alias("section_title"))


@Q.plan(
    "c2_section_resolve",
    rf"""
WITH {_LINES},
h AS (SELECT *, length(trim(line)) BETWEEN 1 AND {_HEADING} AS heading FROM l),
r AS (SELECT *, max(CASE WHEN heading THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS start FROM h),
s AS (SELECT doc_id, start AS ord, 's' || start AS sec_id, max(line) FILTER (heading) AS title, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT heading AND length(line) >= {_CONTENT}), '') AS content,
  CASE WHEN start % 7 <> 6 THEN start END AS start FROM r WHERE start IS NOT NULL GROUP BY doc_id, r.start),
n AS (SELECT *, regexp_replace(trim(title), '[\s　.,、:：]+', '', 'g') AS key, trim(content) <> '' AS full, lead(start IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) AS next FROM s),
a AS (SELECT doc_id, ord AS ref, CASE (doc_id + ord) % 5 WHEN 0 THEN sec_id ELSE '?' END AS section_id,
  CASE (doc_id + ord) % 5 WHEN 1 THEN ' ' || title || '  ' WHEN 2 THEN left(title, greatest(length(title) - 4, 0)) WHEN 3 THEN title || ': continued' WHEN 4 THEN 'nothing of that name' ELSE title END AS wanted FROM s),
w AS (SELECT *, regexp_replace(trim(wanted), '[\s　.,、:：]+', '', 'g') AS wanted_key FROM a),
e AS (SELECT w.doc_id, w.ref, n.ord, n.full FROM w JOIN n ON n.doc_id = w.doc_id AND trim(n.title) = trim(w.wanted)),
p AS (SELECT w.doc_id, w.ref, n.ord, n.full FROM w JOIN n ON n.doc_id = w.doc_id AND w.wanted_key <> '' AND n.key <> '' AND (contains(n.key, w.wanted_key) OR contains(w.wanted_key, n.key))
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = w.doc_id AND e.ref = w.ref)),
c AS (SELECT doc_id, ref, min(ord) AS first, min(ord) FILTER ("full") AS filled, any_value(kind) AS kind FROM (SELECT *, 'exact' AS kind FROM e UNION ALL SELECT *, 'part' FROM p) GROUP BY doc_id, ref),
o AS (SELECT w.doc_id, w.ref, CASE WHEN i.ord IS NOT NULL THEN 'id' ELSE c.kind END AS found, coalesce(i.ord, c.first) AS mine, CASE WHEN NOT coalesce(i."full", f."full", false) THEN c.filled END AS other
  FROM w LEFT JOIN n i ON i.doc_id = w.doc_id AND i.sec_id = w.section_id LEFT JOIN c ON c.doc_id = w.doc_id AND c.ref = w.ref LEFT JOIN n f ON f.doc_id = c.doc_id AND f.ord = c.first AND i.ord IS NULL),
g AS (SELECT n.doc_id, n.ord, string_agg(l.line, chr(10) ORDER BY l.pos) AS blocks FROM n JOIN l ON l.doc_id = n.doc_id AND l.pos > n.start AND l.line <> '' AND (n.next IS NULL OR l.pos < n.next) GROUP BY n.doc_id, n.ord),
x AS (SELECT o.doc_id, o.ref, n.sec_id, n.title, o.found, n.content, g.blocks, CASE WHEN o.other IS NOT NULL THEN 'candidate' WHEN n."full" THEN 'own' WHEN trim(regexp_replace(g.blocks, '\s+', ' ', 'g')) <> '' THEN 'range' WHEN contains(n.title, 'the') THEN 'title' END AS source
  FROM o JOIN n ON n.doc_id = o.doc_id AND n.ord = coalesce(o.other, o.mine) LEFT JOIN g ON g.doc_id = n.doc_id AND g.ord = n.ord)
SELECT doc_id, ref, sec_id, title, CASE source WHEN 'range' THEN blocks WHEN 'title' THEN title ELSE content END AS content, found, source FROM x WHERE source IS NOT NULL
""",
)
def section_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to sections of documents, resolved by id, title and part of a title; titles with `the` stand for themselves where all else is empty."""
    sections, blocks = asked_documents(spark, sf_dir)
    return locate.resolve(asked_sections(sections), sections, blocks, F.col("title").contains("the"))


def template_spans(rows: DataFrame) -> DataFrame:
    """doc_id, title, start, end, chars, piped of each heading of numbered_lines(): its lines up to the next heading of its level or above.

    The level of a heading is 1 to 3, by its length. chars and piped (lines with a bar) leave the heading itself out; both are
    differences of running sums, so that no line is copied for each span that it lies in; only headings travel as text.
    """
    level = F.when(F.col("heading"), F.when(F.length("line") <= 20, 1).when(F.length("line") <= 40, 2).otherwise(3)).otherwise(0)
    rows = rows.select("doc_id", "pos", level.alias("level"), F.when(F.col("heading"), F.col("line")).alias("line"), F.length(F.trim("line")).alias("q_chars"), F.col("line").contains("|").cast("long").alias("q_piped"))
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("q_chars", F.sum("q_chars").over(upto)).withColumn("q_piped", F.sum("q_piped").over(upto))
    spans = S.ends(rows.select("doc_id", "pos", "level", "line", "q_chars", "q_piped")).where("level > 0")
    last = rows.select("doc_id", (F.col("pos") + 1).alias("end_pos"), F.col("q_chars").alias("q_c"), F.col("q_piped").alias("q_p"))
    out = spans.join(last, ["doc_id", "end_pos"])
    return out.select("doc_id", F.col("line").alias("title"), F.col("pos").alias("start"), F.col("end_pos").alias("end"), (F.col("q_c") - F.col("q_chars")).alias("chars"), (F.col("q_p") - F.col("q_piped")).alias("piped"))


def best_spans(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, ref, start, end, chars, piped, score of the heading most like each asked title (doc_id, ref, title); the first one wins ties."""
    alike = similar.similar_titles(asked, spans, "doc_id")
    first = spans.groupBy("doc_id", "title").agg(F.min_by(F.struct("start", "end", "chars", "piped"), "start").alias("span"))
    scored = alike.join(first.withColumnRenamed("title", "b"), ["doc_id", "b"])
    best = scored.groupBy("doc_id", "a").agg(F.min_by(F.struct("span.*", "score"), F.struct(-F.col("score"), F.col("span.start"))).alias("best"))
    return asked.join(best.withColumnRenamed("a", "title"), ["doc_id", "title"]).select("doc_id", "ref", "best.*")


#: What makes an evidence substantive: a table, or this many characters.
_SUBSTANCE = 60


@Q.plan("m6_template_evidence")
def template_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for asked sections: what resolves by id or exact title if it is substantive, else the span of the most similar heading if that is.

    What each part found is stored, a row an asked section or heading, so that the parts are planned and shuffled one after the other.
    """
    sections, blocks = asked_documents(spark, sf_dir)
    asked = asked_sections(sections)
    found = locate.resolve(asked, sections, blocks).where("found <> 'part'")
    located = found.where(F.col("content").contains("|") | (F.length("content") >= _SUBSTANCE)).select("doc_id", "ref", F.lit("located").alias("how"), F.regexp_extract("sec_id", "[0-9]+", 0).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("double").alias("score"))
    located = materialised(located)
    released(spark)
    rest = materialised(asked.join(located, ["doc_id", "ref"], "left_anti").select("doc_id", "ref", F.col("section_title").alias("title")))
    headings = materialised(template_spans(with_starts(lines(headed(spark, sf_dir)))))
    released(spark)
    spans = best_spans(rest, headings).where((F.col("piped") > 0) | (F.col("chars") >= _SUBSTANCE))
    return located.unionByName(spans.select("doc_id", "ref", F.lit("similar").alias("how"), "start", "end", "score"))


#: Points of a line for each word that it holds, and its excerpt's most lines and characters. A heading of at most 20 characters is a boundary.
POINTS = (("ing", 8), ("the", 5), ("ou", 2))
_ROWS, _CHARS, _BOUNDARY = 18, 600, 20


def best_excerpts(rows: DataFrame, points: tuple[tuple[str, int], ...] = POINTS, most_rows: int = _ROWS, most_chars: int = _CHARS) -> DataFrame:
    """doc_id, start, end (last line), points, excerpt: the run of lines with the most points, the first one of equals, of each document with any.

    A run has at most most_rows lines and most_chars characters with line breaks, and no boundary behind its first line; a first line that is longer by
    itself is a run, cut in its middle. Points never fall as a run grows, so each line begins one candidate, its longest run, which running
    sums tell; no run's lines are gathered but the best one's.
    """
    own = sum((F.when(F.col("line").contains(w), n).otherwise(0) for w, n in points), F.lit(0))
    order = Window.partitionBy("doc_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = F.length(F.trim("line")).between(1, _BOUNDARY).cast("int")
    rows = rows.select("doc_id", "pos", "line", own.alias("q_own"), (F.length("line") + 1).alias("q_len"), bound.alias("q_bound"))
    rows = rows.withColumns({"q_points": F.sum("q_own").over(upto), "q_chars": F.sum("q_len").over(upto), "q_bounds": F.sum("q_bound").over(upto)})
    ahead = F.array(*[F.struct(F.lit(d).alias("d"), F.lead("q_points", d).over(order).alias("points"), F.lead("q_chars", d).over(order).alias("chars"), F.lead("q_bounds", d).over(order).alias("bounds")) for d in range(most_rows)])
    fits = lambda x: (x["d"] == 0) | ((x["chars"] - F.col("q_chars") + F.col("q_len") - 1 <= most_chars) & (x["bounds"] == F.col("q_bounds")))
    longest = F.element_at(F.filter("q_ahead", lambda x: x["points"].isNotNull() & fits(x)), -1)
    runs = rows.withColumn("q_ahead", ahead).withColumn("q_best", longest).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + F.col("q_best.d")).alias("end"), (F.col("q_best.points") - F.col("q_points") + F.col("q_own")).alias("points"))
    best = runs.where("points > 0").groupBy("doc_id").agg(F.min_by(F.struct("start", "end", "points"), F.struct(-F.col("points"), F.col("start"))).alias("b")).select("doc_id", "b.*")
    lined = rows.select("doc_id", "pos", "line").join(best, "doc_id").where("pos BETWEEN start AND end").groupBy("doc_id", "start", "end", "points").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    return lined.select("doc_id", "start", "end", "points", T.head_tail(text, most_chars).alias("excerpt"))


@Q.plan(
    "m7_excerpt",
    f"""
WITH {_LINES},
w AS (SELECT *, {" + ".join(f"{n} * contains(line, '{w}')::INT" for w, n in POINTS)} AS own, (length(trim(line)) BETWEEN 1 AND {_BOUNDARY})::INT AS bound FROM l),
r AS (SELECT a.doc_id, a.pos AS start, b.pos AS "end", sum(c.own)::BIGINT AS points, string_agg(c.line, chr(10) ORDER BY c.pos) AS text FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + {_ROWS - 1}
  JOIN w c ON c.doc_id = a.doc_id AND c.pos BETWEEN a.pos AND b.pos GROUP BY a.doc_id, a.pos, b.pos HAVING b.pos = a.pos OR (sum(length(c.line) + 1) - 1 <= {_CHARS} AND sum(CASE WHEN c.pos > a.pos THEN c.bound ELSE 0 END) = 0)),
k AS (SELECT * FROM r WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, start, "end" DESC) = 1)
SELECT doc_id, start, "end", points, CASE WHEN length(text) <= {_CHARS} THEN text ELSE left(text, {int(_CHARS * 0.7)}) || ' ... ' || right(text, {_CHARS - int(_CHARS * 0.7)}) END AS excerpt FROM k
""",
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best excerpt of each document."""
    rows = lines(table(spark, sf_dir, "documents")).withColumn("pos", F.col("pos").cast("long"))
    return best_excerpts(rows).withColumn("points", F.col("points").cast("long"))


_KEEP = ("ing", "que")


@Q.plan(
    "h10_keyword_cut",
    f"""
WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(substr(text, 361, n - 480), chr(10)) AS x FROM d WHERE n > 800)),
k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS i FROM m WHERE {" OR ".join(f"contains(line, '{w}')" for w in _KEEP)} GROUP BY doc_id, line),
f AS (SELECT doc_id, 0::BIGINT AS i, '' AS kept FROM d WHERE n > 800 UNION ALL SELECT f.doc_id, k.i, CASE WHEN length(kept) + length(line) + 1 <= 320 THEN kept || chr(10) || line ELSE kept END FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1),
e AS (SELECT doc_id, arg_max(kept, i) AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n <= 800 THEN text ELSE left(text, 360) || kept || chr(10) || right(text, 120) END AS text FROM d LEFT JOIN e ON e.doc_id = d.doc_id
""",
)
def keyword_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to 800 characters around what names a keyword."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.keyword_cut(F.col("text"), 800, _KEEP).alias("text"))
