"""Composition lists over the documents' lines; the counterparts find them by joins and by a recursion for each anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import composition as C
from docquarry.operators import outlines
from docquarry.plans.query import Catalog, table
from docquarry.sources.readers import lines

Q = Catalog()
_LINES = "l AS (SELECT doc_id, unnest(range(0, len(s)))::INT AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"

#: Portable SQL: numbers before a document's lines, nine at a time below an introduction.
_NUMBERED = """CASE WHEN pos % 9 = 0 THEN '2.' || (pos % 4 + 1) || ' It shall consist of: ' || line WHEN pos % 9 < 5 THEN '2.' || ((pos - pos % 9) % 4 + 1) || '.' || (pos % 9) || ' ' || line
  WHEN pos % 9 = 5 THEN '2.' || ((pos - 5) % 4 + 1) || '.4.1 ' || line WHEN pos % 9 = 6 AND (doc_id + pos) % 2 = 0 THEN ' 2.' || ((pos - 6) % 4 + 1) || '.9 ' || line WHEN (doc_id + pos) % 5 = 0 THEN '3.1 ' || line ELSE line END"""


@Q.plan(
    "e19_dotted_children",
    rf"""WITH {_LINES}, t AS (SELECT doc_id, pos, ltrim({_NUMBERED}) AS line FROM l WHERE (doc_id + pos) % 7 > 0),
n AS (SELECT doc_id, pos, line, regexp_extract(line, '^([0-9]+(?:\.[0-9]+){{1,4}})', 1) AS number FROM t),
i AS (SELECT doc_id, pos AS intro, regexp_extract(line, '^([0-9]+(?:\.[0-9]+){{1,3}})', 1) AS p FROM t WHERE contains(line, 'shall consist of')),
c AS (SELECT i.doc_id, i.intro, i.p, n.pos FROM i JOIN n ON n.doc_id = i.doc_id AND n.pos > i.intro AND i.p <> '' AND regexp_replace(n.number, '\.[0-9]+$', '') = i.p AND n.number <> i.p),
f AS (SELECT doc_id, intro, p, min(pos) AS at FROM c GROUP BY ALL),
e AS (SELECT f.doc_id, f.intro, min(n.pos) AS stop FROM f JOIN n ON n.doc_id = f.doc_id AND n.pos > f.at AND NOT starts_with(n.number, f.p || '.') GROUP BY ALL),
k AS (SELECT c.doc_id, c.intro, c.pos, count(*) OVER (PARTITION BY c.doc_id, c.intro) AS n FROM c LEFT JOIN e ON e.doc_id = c.doc_id AND e.intro = c.intro WHERE c.pos < coalesce(stop, 2147483647))
SELECT doc_id, intro::BIGINT AS intro, pos::BIGINT AS pos FROM k WHERE n >= 3 QUALIFY intro = min(intro) OVER (PARTITION BY doc_id)""",
)
def dotted_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered lines below each document's first introduction that has three; every seventh line is missing."""
    rows = lines(table(spark, sf_dir, "documents")).where("(doc_id + pos) % 7 > 0").select("doc_id", "pos", F.expr(_NUMBERED).alias("line"))
    return C.numbered_children(rows, "doc_id", "pos", "line", F.contains("line", F.lit("shall consist of")))


#: Portable SQL: what a line is as a title.
_TITLE = {
    "unified": "(pos + doc_id) % 37 = 6", "stop": "(pos + doc_id) % 41 = 5", "detail": "(pos + doc_id) % 7 = 1", "header": "(pos + doc_id) % 11 = 2", "wrapper": "(pos + doc_id) % 9 = 4",
    "closing": "(pos + doc_id) % 2 = 1", "left_out": "(pos + doc_id) % 17 = 3", "item": "pos * 7 % 20 <> 0", "marked": "(pos + doc_id) % 23 = 0",
}
#: Portable SQL: every other line is cut down to a short title.
_SHORT = "CASE WHEN pos % 2 = 0 THEN 'title ' || pos ELSE line END"


@Q.plan(
    "e20_following_titles",
    rf"""WITH RECURSIVE {_LINES}, s AS (SELECT doc_id, pos, length(regexp_replace({_SHORT}, '[\s\p{{Z}}]+', '', 'g')) AS size, pos % 8 = 0 AS anchor, {", ".join(f"{v} AS {k}" for k, v in _TITLE.items())} FROM l),
f AS (SELECT doc_id, pos AS anchor, pos, 0 AS n, 'go' AS did FROM s WHERE anchor UNION ALL
  SELECT doc_id, f_anchor, pos, n + (act = 'take')::INT, act FROM (SELECT s.doc_id, f.anchor AS f_anchor, s.pos, f.n, CASE WHEN size = 0 THEN 'go' WHEN f.n > 0 THEN
    CASE WHEN unified OR stop THEN 'end' WHEN detail OR header THEN 'go' WHEN wrapper THEN CASE WHEN closing AND f.n >= 10 THEN 'end' ELSE 'go' END WHEN left_out THEN 'go' WHEN item THEN 'take' ELSE 'end' END
    ELSE CASE WHEN header THEN 'go' WHEN wrapper THEN CASE WHEN size <= 32 THEN 'go' ELSE 'end' END WHEN item THEN 'take' WHEN size <= 28 THEN 'go' ELSE 'end' END END AS act
    FROM f JOIN s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1 WHERE f.did <> 'end')),
k AS (SELECT f.doc_id, f.anchor, f.pos, count(*) OVER w AS n, bool_or(marked) OVER w AS m FROM f JOIN s ON s.doc_id = f.doc_id AND s.pos = f.pos WHERE did = 'take' WINDOW w AS (PARTITION BY f.doc_id, f.anchor))
SELECT doc_id, anchor::BIGINT AS anchor, pos::BIGINT AS pos FROM k WHERE n >= 5 OR n >= 3 AND m""",
)
def following_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every eighth line announces, taken from the lines behind it as titles."""
    rows = lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.expr(_SHORT).alias("title"), F.expr("pos % 8 = 0 AS anchor"), *[F.expr(v).alias(k) for k, v in _TITLE.items()])
    return C.following_titles(rows, "doc_id", "pos", "title", "anchor")


_ENGLISH = C.Clauses("deposit", ("depositreceipt", "bankguarantee"), ("invalidoffer", "rejected"), ("forfeited", "withdrawn"), ("depositwill", "refund"), "table")
#: Portable SQL: titles, relevance and contents around the documents' texts.
_CLAUSE = {
    "title": "CASE doc_id % 6 WHEN 0 THEN 'Deposit  receipt, deposit receipt' WHEN 1 THEN 'Invalid offer' WHEN 2 THEN 'On the deposit' WHEN 3 THEN NULL ELSE 'Section table' END",
    "relevance": "CASE doc_id % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'the deposit' ELSE '' END",
    "content": "CASE doc_id % 5 WHEN 0 THEN 'It is forfeited. ' WHEN 1 THEN 'The deposit will return. ' WHEN 2 THEN 'Bank guarantee, refund. ' WHEN 3 THEN 'List:' || chr(10) || 'item score' || chr(10) ELSE 'item | score' || chr(10) || 'List:' || chr(10) END || text",
}


def _one(text: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({text}, '{'|'.join(words)}')"


@Q.plan(
    "b17_clause_sections",
    rf"""WITH s AS (SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in _CLAUSE.items())} FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, regexp_replace(coalesce(title, ''), '[\s\p{{Z}}]+', '', 'g') AS t, regexp_replace(relevance, '[\s\p{{Z}}]+', '', 'g') AS r, regexp_replace(left(content, 1800), '[\s\p{{Z}}]+', '', 'g') AS c FROM s),
a AS (SELECT *, contains(t, 'deposit') AND {_one("t", _ENGLISH.proofs)} AS titled, contains(t || r || c, 'deposit') AND {_one("t || r || c", _ENGLISH.proofs)} AS proof,
  string_split_regex(content, '\r\n|\n|\r')[1:80] AS head FROM k),
h AS (SELECT *, array_to_string(head, chr(10)) AS sample, list_position(list_transform(head, lambda x: contains(x, 'item') AND contains(x, 'score')), true) AS header, list_position(list_transform(head, lambda x: starts_with(x, 'List:')), true) AS opening FROM a)
SELECT doc_id, NOT titled AND ({_one("t", _ENGLISH.invalid)} OR {_one("r", _ENGLISH.invalid)} OR contains(t || r, 'deposit') AND ({_one("t || r || c", _ENGLISH.forfeit)} OR NOT proof AND {_one("t || r || c", _ENGLISH.kept)})) AS risk,
contains(sample, 'item') AND contains(sample, 'score') AND NOT coalesce(opening > 0 AND header > 0 AND opening < header, false)
  AND (contains(sample, '|') OR contains(coalesce(title, ''), 'table') OR contains(left(sample, 300), 'table')) AS review FROM h""",
)
def clause_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections: which are risk clauses, which are forms for reviewing."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", *[F.expr(v).alias(k) for k, v in _CLAUSE.items()])
    return rows.select("doc_id", C.risk_clause(F.col("title"), F.col("relevance"), F.col("content"), _ENGLISH).alias("risk"), C.review_table(F.col("title"), F.col("content"), "^List:", ("item", "score"), _ENGLISH).alias("review"))


#: Portable SQL: the parts of a brand and size as rows of a document; three sizes in ten are index tables.
_ROWS = """SELECT doc, n, CASE WHEN k = 1 THEN 'Top' ELSE 'N ' || (n * 7 % 13) END AS name, CASE WHEN n % 3 = 0 THEN '| ' || n || ' | Set ' || (n % 4) || ' | x | y |' END AS quote, CAST(n % 4 + 1 AS INT) AS level,
CASE WHEN of_index THEN CASE WHEN n % 3 > 0 THEN 'Group ' || (n % 2) END WHEN n % 9 = 0 THEN 'top' WHEN n % 9 = 1 THEN 'nowhere' END AS parent_name, CASE WHEN of_index THEN 'index_table' ELSE 'text' END AS source_kind
FROM (SELECT p_brand || '-' || (p_size % 10) AS doc, p_partkey AS n, p_size % 10 < 3 AS of_index, row_number() OVER (PARTITION BY p_brand, p_size % 10 ORDER BY p_partkey) AS k FROM {part}) p"""


@Q.plan(
    "l2_outline",
    f"""WITH RECURSIVE r AS ({_ROWS.format(part="part")}),
i AS (SELECT doc, n, name, coalesce(parent_name, 'Set ' || (n % 4)) AS grp FROM r WHERE source_kind = 'index_table' QUALIFY count(DISTINCT coalesce(parent_name, 'Set ' || (n % 4))) OVER (PARTITION BY doc) >= 2),
g AS (SELECT doc, grp, min(n) AS n FROM i GROUP BY 1, 2), h AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n) AS o FROM g),
c AS (SELECT doc, grp, name, min(n) AS n FROM i GROUP BY 1, 2, 3),
d AS (SELECT doc, name, min(n) AS n, arg_min(level, n) AS level, arg_min(coalesce(parent_name, ''), n) AS wanted FROM r WHERE doc NOT IN (SELECT doc FROM i) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n) AS k, min(n) OVER (PARTITION BY doc) AS top FROM d),
f AS (SELECT doc, k, n, [n, 0, 0, 0] AS st, NULL::BIGINT AS parent FROM k WHERE k = 1 UNION ALL
  SELECT doc, k, n, list_transform([1, 2, 3, 4], lambda j: CASE WHEN j = CASE WHEN p IS NULL THEN 1 ELSE level END THEN n WHEN j > CASE WHEN p IS NULL THEN 1 ELSE level END THEN 0 ELSE st[j] END), p FROM (
    SELECT k.doc, k.k, k.n, k.level, f.st, CASE WHEN wanted = 'top' THEN top WHEN level > 3 AND st[3] > 0 THEN st[3] WHEN level > 2 AND st[2] > 0 THEN st[2] WHEN level > 1 AND st[1] > 0 THEN st[1] END AS p
    FROM f JOIN k ON k.doc = f.doc AND k.k = f.k + 1)),
o AS (SELECT doc, n, parent, row_number() OVER (PARTITION BY doc, parent ORDER BY n) AS o FROM f),
t AS (SELECT doc, n, o::VARCHAR AS number, NULL::VARCHAR AS parent FROM o WHERE parent IS NULL UNION ALL SELECT o.doc, o.n, t.number || '.' || o.o, t.number FROM o JOIN t ON t.doc = o.doc AND t.n = o.parent)
SELECT t.doc, t.n, number, parent, name, 'row' AS kind FROM t JOIN d ON d.doc = t.doc AND d.n = t.n
UNION ALL SELECT doc, n, o::VARCHAR, NULL, grp, 'group' FROM h
UNION ALL SELECT c.doc, c.n, h.o || '.' || row_number() OVER (PARTITION BY c.doc, c.grp ORDER BY c.n), h.o::VARCHAR, name, 'row' FROM c JOIN h ON h.doc = c.doc AND h.grp = c.grp""",
)
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands' parts of a size as an outline each."""
    return outlines.outline(spark.sql(_ROWS.format(part=f"parquet.`{sf_dir}/part.parquet`")), "doc", "n")
