"""Scans, extraction rules, evidence joins and folds of the longer tail, over the fixture tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import folds, profiles
from docquarry.plans.query import Catalog, table
from docquarry.runtime import ship
from docquarry.sources.readers import lines

Q = Catalog()
sql = Q.sql
_SEQ = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM @events)"

# Scans
sql("a8_section_scan", f"SELECT user_id, n AS start_block, lead(n) OVER (PARTITION BY user_id ORDER BY n) AS end_block FROM {_SEQ} e WHERE event_type = 'signup'")
sql("a10_project_scan", "SELECT coalesce(d.doc_id, l.doc_id) AS id, d.source, l.quality FROM @documents d FULL OUTER JOIN @labels l ON d.doc_id = l.doc_id ORDER BY id DESC LIMIT 500")
sql("a11_template_library", "SELECT r_regionkey, count(n_nationkey) AS chapters FROM @region LEFT JOIN @nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
sql("a14_page_scan", "SELECT page_id, length(html) AS n, lower(left(html, 60)) AS head FROM @pages")
sql("a18_table_scan", "SELECT s_suppkey, s_name FROM @supplier WHERE s_acctbal >= 0")

# Predicates

# Joins
sql("c25_citation_allow", "SELECT e.event_id FROM @events e LEFT SEMI JOIN @documents d ON e.event_id = d.doc_id", "SELECT e.event_id FROM events e SEMI JOIN documents d ON e.event_id = d.doc_id")

# Aggregates
sql("d22_latest_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC) AS y FROM @orders) o WHERE y = 1")

# Ranks
sql("f4_candidates_3_5", "SELECT p_brand, p_partkey, kind FROM (SELECT p_brand, p_partkey, p_size % 2 AS kind, row_number() OVER (PARTITION BY p_brand, p_size % 2 ORDER BY p_retailprice DESC, p_partkey) AS n FROM @part) p WHERE n <= CASE kind WHEN 0 THEN 3 ELSE 5 END")
sql("f6_related_top", "SELECT user_id, event_type, hits FROM (SELECT user_id, event_type, count(*) AS hits, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS n FROM @events GROUP BY user_id, event_type) e WHERE n <= 5")

# Texts
sql("k11_known_paths", "SELECT event_id, coalesce(get_json_object(props, '$.k'), 'none') AS k, get_json_object(props, '$.missing') IS NULL AS absent FROM @events", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, json_extract_string(props, '$.missing') IS NULL AS absent FROM events")

# Reports
sql("m6_substantive", "SELECT doc_id, text LIKE '%|%' OR length(text) >= 60 AS substantive FROM @documents")
sql("o2_state_reducers", "SELECT user_id, max_by(event_type, struct(ts, event_id)) AS last_status, count_if(event_type = 'error') AS warnings FROM @events GROUP BY user_id", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_status, count_if(event_type = 'error') AS warnings FROM events GROUP BY user_id")
sql("q6_heading_policy", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 1 WHEN p_size > 20 THEN 2 ELSE 3 END AS heading_level FROM @part")


@Q.plan("m7_best_excerpt", "SELECT doc_id, min(pos) AS pos FROM (SELECT doc_id, pos, score, max(score) OVER (PARTITION BY doc_id) AS best FROM (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(list_transform(l, lambda x: 8 * contains(x, 'ing')::INT + 5 * contains(x, 'the')::INT + 2 * (length(x) > 40)::INT)) AS score FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))) WHERE score = best GROUP BY doc_id")
def best_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line with the best score of 8, 5 and 2 points."""
    hit = lambda c: c.cast("int")
    score = 8 * hit(F.col("line").contains("ing")) + 5 * hit(F.col("line").contains("the")) + 2 * hit(F.length("line") > 40)
    rows = lines(table(spark, sf_dir, "documents")).withColumn("score", score)
    return rows.groupBy("doc_id").agg(F.min_by("pos", F.struct(-F.col("score"), F.col("pos"))).cast("long").alias("pos"))


@Q.plan("e16_repeat_headings", 'WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)), r AS (SELECT doc_id, pos, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l WHERE length(trim(line)) BETWEEN 1 AND 80), f AS (SELECT doc_id, k, pos, t AS last, true AS kept FROM r WHERE k = 1 UNION ALL SELECT doc_id, k, pos, CASE WHEN ok THEN t ELSE last END, ok FROM (SELECT r.*, f.last, NOT (r.t = f.last OR length(r.t) >= 6 AND contains(f.last, r.t)) AS ok FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k + 1)) SELECT doc_id, pos::INT AS pos FROM f WHERE kept')
def repeat_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that repeat the last kept one become body: a fold per document, as the last kept heading depends on all before."""
    rows = lines(table(spark, sf_dir, "documents")).where(F.length(F.trim("line")).between(1, 80)).select("doc_id", "pos", F.trim("line").alias("t"))
    return folds.unrepeated(rows, "doc_id", "pos", "t")


@Q.plan("h13_line_merge", "WITH l AS (SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)), r AS (SELECT *, coalesce(regexp_matches(lag(line) OVER (PARTITION BY doc_id ORDER BY pos), '[.!?:]$'), true) AS brk FROM l WHERE trim(line) <> ''), p AS (SELECT *, sum(brk::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS para FROM r) SELECT doc_id, para::BIGINT AS para, string_agg(line, ' ' ORDER BY pos) AS text FROM p GROUP BY doc_id, para")
def line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined to paragraphs: a line that doesn't end a sentence goes on in the next one."""
    rows = lines(table(spark, sf_dir, "documents")).where(F.trim("line") != "")
    order = Window.partitionBy("doc_id").orderBy("pos")
    broken = F.coalesce(F.lag("line").over(order).rlike("[.!?:]$"), F.lit(True))
    para = rows.withColumn("brk", broken.cast("int")).withColumn("para", F.sum("brk").over(order))
    return para.groupBy("doc_id", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("text"))


@Q.plan("j5_bigram_cosine", 'WITH g AS (SELECT s_suppkey, s_nationkey, substr(k, i, 2) AS g, count(*) AS c FROM (SELECT s_suppkey, s_nationkey, lower(s_name) AS k, unnest(range(1, length(s_name))) AS i FROM supplier) GROUP BY ALL), n AS (SELECT s_suppkey, sqrt(sum(c * c)) AS norm FROM g GROUP BY 1) SELECT a.s_suppkey, b.s_suppkey AS other, round(sum(a.c * b.c) / max(x.norm) / max(y.norm), 6) AS cosine FROM g a JOIN g b ON a.s_nationkey = b.s_nationkey AND a.g = b.g AND a.s_suppkey < b.s_suppkey JOIN n x ON x.s_suppkey = a.s_suppkey JOIN n y ON y.s_suppkey = b.s_suppkey GROUP BY 1, 2')
def bigram_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of character-bigram counts between suppliers' names of one nation: nearly all pairs have a bigram in common, so they are made block by block."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", T.match_key(F.col("s_name")).alias("k"))
    grams = s.where(F.length("k") > 1).select("s_suppkey", "s_nationkey", F.explode(T.parts_of(F.col("k"), 2)).alias("g")).groupBy("s_suppkey", "s_nationkey", "g").count()
    return profiles.cosines(grams, "s_suppkey", "s_nationkey", "g", "count", "other")


_TOKENS = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<string>"(?:[^"\\]|\\.)*(?:"|\Z))|(?P<bare>[-+.\w]+)|(?P<mark>[{}\[\]:])', re.S)


def tolerant(raw: str | None):
    """The value that the first bracket of a model's answer opens, or None: read token by token into open containers, so that fences, prose,
    comments and stray or missing commas are passed over, and whatever is still open at the end counts as complete.

    A field without a value is null; a bare word that is no number, true, false or null is a string; a closing bracket ends the innermost
    container of its kind, and those inside it.
    """
    top: list = []
    open_now: list[tuple[str, object]] = [("]", top)]
    field: dict[int, str] = {}  # by depth: the key that waits for its value

    def put(value) -> None:
        kind, box = open_now[-1]
        if kind == "]":
            box.append(value)
        elif (depth := len(open_now)) in field:
            box[field.pop(depth)] = value
        elif isinstance(value, str):
            box[value] = None
            field[depth] = value

    for m in _TOKENS.finditer(raw or ""):
        mark = m["mark"]
        if mark in ("{", "["):
            box: object = {} if mark == "{" else []
            put(box)
            field.pop(len(open_now) + 1, None)
            open_now.append(("}" if mark == "{" else "]", box))
        elif mark in ("}", "]"):
            inner = [k for k in range(1, len(open_now)) if open_now[k][0] == mark]
            del open_now[inner[-1] if inner else len(open_now) :]
            if len(open_now) == 1 and top:
                break
        elif len(open_now) > 1 and (m["string"] or m["bare"]):
            text = m["string"] or m["bare"]
            try:
                put(json.loads(text if text[0] != '"' or (len(text) > 1 and text[-1] == '"') else text + '"', strict=False))
            except ValueError:
                put(text.strip('"'))
    return top[0] if top else None


def repaired(raw: str | None) -> str | None:
    """tolerant() as JSON."""
    value = tolerant(raw)
    return None if value is None else json.dumps(value, sort_keys=True, ensure_ascii=False)


@Q.plan("k4_json_repair", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties cut off before their last bracket, repaired and read."""
    ship(spark)

    @F.pandas_udf("string")
    def fix(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(repaired)

    cut = F.concat(F.lit("```json\n"), F.expr("left(props, length(props) - 1)"), F.lit(","))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(fix(cut), "$.k").cast("int").alias("k"))


@Q.plan("k3_slot_fold", "SELECT o_custkey, max(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS has_amount, count_if(o_orderpriority NOT LIKE '1%') AS listed FROM orders GROUP BY o_custkey")
def slot_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows routed to a first-wins slot or to a list, per customer."""
    urgent = F.col("o_orderpriority").startswith("1")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(urgent.cast("int")).alias("has_amount"), F.count_if(~urgent).alias("listed"))


@Q.plan("p3_material_split", "SELECT doc_id, count(*) AS parts FROM (SELECT doc_id, unnest(string_split(string_split(text, chr(10))[1], ',')) AS p FROM documents) WHERE trim(p) <> '' GROUP BY doc_id")
def material_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first line's comma-separated parts, as rows."""
    head = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(head, ",")).alias("p")).where(F.trim("p") != "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))
