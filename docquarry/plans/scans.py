"""Scans of blocks, projects and templates that Spark derives from the tables; the counterparts are written on their own (a recursive stack for sections)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import scanning, splitting
from docquarry.plans.query import Catalog, table
from docquarry.sources import projects
from docquarry.sources.readers import lines
from docquarry.streaming import reducers

Q = Catalog()

#: Portable SQL: what stands around a document's lines (doc_id, pos, line) as blocks. A third of the documents has styles, a third one heading only.
_BLOCK = {
    "kind": "CASE WHEN pos % 7 = 3 THEN 'table' ELSE 'paragraph' END",
    "text": "CASE WHEN pos % 5 = 0 THEN '1.' || (pos % 3 + 1) || CASE WHEN pos % 2 = 0 THEN '.2 ' ELSE '、' END || line ELSE line END",
    "style": "CASE WHEN doc_id % 3 = 0 AND pos % 4 = 1 THEN 'Heading ' || ((pos + doc_id) % 5 + 1) WHEN doc_id % 3 = 1 AND pos = 2 THEN 'TOC 1' END",
    "outline": "CASE WHEN doc_id % 3 < 2 AND pos % 11 = 5 THEN doc_id % 4 END",
    "images": "pos % 3",
    "graphics": "pos % 2",
}
_SECTIONS = rf"""l AS (SELECT doc_id, unnest(range(0, len(s)))::INT AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
b AS (SELECT doc_id, pos, {", ".join(f"{v} AS {k}" for k, v in _BLOCK.items())} FROM l),
e AS (SELECT * REPLACE (regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS text) FROM b),
w AS (SELECT *, CASE WHEN kind <> 'paragraph' OR text = '' OR style LIKE 'TOC%' THEN 0 WHEN style IS NOT NULL THEN right(style, 1)::INT ELSE outline + 1 END AS own,
  regexp_extract(text, '^([0-9]+(?:\.[0-9]+)*)(?:[.、]\s*|\s+)', 1) AS number FROM e),
g AS (SELECT *, count(*) FILTER (own > 0) OVER (PARTITION BY doc_id) AS explicit FROM w),
v AS (SELECT doc_id, pos, text, coalesce(own, CASE WHEN explicit < 3 AND number <> '' AND length(text) <= 80 THEN least(len(string_split(number, '.')), 4) ELSE 0 END)::INT AS level FROM g),
h AS (SELECT doc_id, pos, level, CASE t WHEN '' THEN '未命名章节' ELSE t END AS title, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM (SELECT *, regexp_replace(text, '^[0-9]+(?:\.[0-9]+)*[.、\s]+', '') AS t FROM v WHERE level > 0)),
f AS (SELECT doc_id, k, pos, level, title, list_concat(list_transform(range(1, level), lambda j: 1), [1]) AS c, [struct_pack(level := level, title := title)] AS st FROM h WHERE k = 1
  UNION ALL SELECT h.doc_id, h.k, h.pos, h.level, h.title, list_concat(list_transform(range(1, h.level), lambda j: coalesce(f.c[j], 1)), [coalesce(f.c[h.level], 0) + 1]),
  list_concat(list_filter(f.st, lambda x: x.level < h.level), [struct_pack(level := h.level, title := h.title)]) FROM f JOIN h ON h.doc_id = f.doc_id AND h.k = f.k + 1),
n AS (SELECT doc_id, count(*) AS blocks FROM b GROUP BY 1),
u AS (SELECT f.doc_id, f.pos, f.level, f.title, f.c, f.st, coalesce(min(x.pos), any_value(n.blocks))::INT AS end_block FROM f JOIN n ON n.doc_id = f.doc_id
  LEFT JOIN h x ON x.doc_id = f.doc_id AND x.pos > f.pos AND x.level <= f.level GROUP BY ALL)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines as blocks."""
    return lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", *[F.expr(v).alias(k) for k, v in _BLOCK.items()])


@Q.plan(
    "a8_sections",
    f"""WITH RECURSIVE {_SECTIONS} SELECT u.doc_id, u.pos, array_to_string(c, '.') AS chapter_id, u.title, array_to_string(list_transform(st, lambda x: x.title), '/') AS full_path, u.level,
u.pos + 1 AS start_block, end_block, sum(images)::BIGINT AS image_count, count(*) FILTER (kind = 'table') AS table_count, sum(graphics)::BIGINT AS graphic_count
FROM u JOIN b ON b.doc_id = u.doc_id AND b.pos >= u.pos AND b.pos < u.end_block GROUP BY ALL""",
)
def section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as office files with styled headings, few, or none."""
    return scanning.section_scan(blocks(spark, sf_dir))


@Q.plan(
    "a16_section_texts",
    rf"""WITH RECURSIVE {_SECTIONS}, x AS (SELECT u.doc_id || ':' || u.pos AS section, e.pos, e.text, coalesce(sum(length(e.text)) OVER (PARTITION BY u.doc_id, u.pos ORDER BY e.pos
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u JOIN e ON e.doc_id = u.doc_id AND e.pos >= u.pos AND e.pos < u.end_block WHERE e.text <> '')
SELECT section, left(string_agg(text, chr(10) ORDER BY pos), 6000) AS content FROM x WHERE before < 6000 GROUP BY 1""",
)
def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every section, with its subsections, up to 6000 characters."""
    rows = blocks(spark, sf_dir)
    found = scanning.section_scan(rows).withColumn("section", F.concat_ws(":", "doc_id", "pos"))
    return scanning.range_text(found, rows, "section")


#: Portable SQL: customers, their orders and their lines as one outline.
_TREE = """SELECT 'c' || c_custkey AS node, CAST(NULL AS STRING) AS parent, 0 AS place, c_name AS title, 'of ' || c_mktsegment AS content FROM {customer} UNION ALL
SELECT 'o' || o_orderkey, 'c' || o_custkey, CAST(o_orderkey % 3 AS INT), o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END FROM {orders} UNION ALL
SELECT 'l' || l_orderkey || '-' || l_linenumber, 'o' || l_orderkey, -l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'part ' || l_partkey END, l_returnflag FROM {lineitem}"""


@Q.plan(
    "m2_assembled",
    f"""WITH t AS ({_TREE.format(customer="customer", orders="orders", lineitem="lineitem").replace("STRING", "VARCHAR")}),
q AS (SELECT node, parent, [struct_pack(o := place, n := node)] AS spot, nullif(title, '') AS title, nullif(content, '') AS content FROM t),
p AS (SELECT node, [] AS places, content AS part FROM q UNION ALL SELECT parent, spot, concat_ws(chr(10), chr(10) || '## ' || title, content) FROM q WHERE parent IS NOT NULL
UNION ALL SELECT m.parent, list_concat(m.spot, q.spot), concat_ws(chr(10), chr(10) || '### ' || q.title, q.content) FROM q JOIN q m ON m.node = q.parent WHERE m.parent IS NOT NULL)
SELECT node, coalesce(string_agg(part, chr(10) ORDER BY len(places) > 0, places[1].o, places[1].n, len(places), places[2].o, places[2].n, part) FILTER (part <> ''), '') AS text
FROM p WHERE node IN (SELECT node FROM t) GROUP BY 1""",
)
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders and lines, orders with their lines."""
    tree = spark.sql(_TREE.format(**{n: f"parquet.`{sf_dir}/{n}.parquet`" for n in ("customer", "orders", "lineitem")}))
    return scanning.assembled(tree, "node", "parent", "place")


#: Portable SQL: a customer's task file, and its result file around the orders' nodes and keys.
_TASK = """CASE WHEN c_custkey % 7 = 0 THEN '{"creator_user_id":"u1"' ELSE '{"creator_user_id":" u' || (c_nationkey % 4) || ' ","filename":"' || CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END
  || '","progress":' || CASE WHEN c_custkey % 2 = 1 THEN '40' ELSE 'null' END || '}' END"""
_RESULT = """'{"outline":[' || coalesce(nodes, '') || '],"generated_sections":{' || coalesce(keys, '') || '},"title_info":{' || CASE WHEN c_custkey % 4 = 0 THEN '"title":"T' || c_custkey || '"' ELSE '' END
  || '},"stats":{"compliance_issue_count":' || (c_custkey % 5) || '}' || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '}' END"""
_NODE = """'{"name":"o' || o_orderkey || '","children":[' || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{}' ELSE '{"children":[{"name":"x"},7]}' END || ']}'"""


@Q.plan(
    "a10_projects",
    """WITH o AS (SELECT o_custkey, count(*) AS n, sum(1 + o_orderkey % 3)::BIGINT AS nodes FROM orders GROUP BY 1),
p AS (SELECT 'c' || c_custkey AS id, c_custkey AS k, CASE WHEN c_custkey % 6 = 0 THEN 'c' || c_custkey ELSE c_name END AS filename, c_custkey % 3 <> 0 AS there, c_custkey % 3 <> 0 AND c_custkey % 11 <> 0 AS sound,
  coalesce(o.n, 0) AS n, coalesce(o.nodes, 0) AS nodes, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 50) AS task_at, TIMESTAMP '2024-01-20' + INTERVAL 1 DAY * (c_custkey % 13) AS result_at
  FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_nationkey % 4 = 1)
SELECT id, filename, CASE WHEN sound AND k % 4 = 0 THEN 'T' || k ELSE filename END AS project_name, CASE WHEN sound THEN 'done' ELSE 'pending' END AS status,
CASE WHEN k % 2 = 1 THEN 40 WHEN sound THEN 100 ELSE 0 END::INT AS progress, CASE WHEN there THEN greatest(task_at, result_at) ELSE task_at END AS updated_at, there AS has_result,
CASE WHEN sound THEN n ELSE 0 END::BIGINT AS generated_section_count, CASE WHEN sound THEN k % 5 ELSE 0 END::BIGINT AS compliance_issue_count, CASE WHEN sound THEN nodes ELSE 0 END::BIGINT AS outline_count
FROM p ORDER BY updated_at DESC, id LIMIT 500""",
)
def project_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One owner's newest projects among the customers' task and result files, some of them broken."""
    listed = lambda c: F.array_join(F.collect_list(c), ",")
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(listed(F.expr(_NODE)).alias("nodes"), listed(F.expr("""'"' || o_orderkey || '":"x"'""")).alias("keys"))
    customer = table(spark, sf_dir, "customer")
    file = lambda df, where, suffix, day, text: df.where(where).select(F.expr(f"'c' || c_custkey || '{suffix}' AS name"), F.expr(f"{day} AS modified"), F.expr(text).alias("text"))
    tasks = file(customer, "c_custkey % 5 <> 0", ".task.json", "timestamp'2024-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 50 AS INT))", _TASK)
    both = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    results = file(both, "c_custkey % 3 <> 0", ".json", "timestamp'2024-01-20 00:00:00' + make_dt_interval(CAST(c_custkey % 13 AS INT))", _RESULT)
    shown = projects.projects(tasks.union(results), "u1", 500)
    return shown.select("id", "filename", "project_name", "status", "progress", "updated_at", "has_result", "generated_section_count", "compliance_issue_count", "outline_count")


@Q.plan(
    "a11_templates",
    """SELECT translate(o_clerk || ' / ' || k, ' /', '__') AS id, o_clerk || ' / ' || k AS name, CASE WHEN k % 2 = 0 THEN '未分类' ELSE 'odd' END AS category, n AS chapter_count, k::VARCHAR AS created_at
FROM (SELECT o_custkey AS k, max(o_orderpriority) AS o_clerk, count(*) AS n FROM orders GROUP BY 1)""",
)
def template_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' orders as saved templates, each saved twice: the later one stays."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("p"), F.collect_list(F.struct(F.col("o_orderstatus").alias("name"))).alias("x"))
    rows = orders.select(F.concat_ws(" / ", "p", "k").alias("name"), F.expr("CASE WHEN k % 2 <> 0 THEN 'odd' END").alias("category"), F.to_json("x").alias("outline"), F.col("k").cast("string").alias("created_at"))
    earlier = rows.withColumns({"outline": F.lit("[]"), "created_at": F.lit("")})
    return projects.templates(projects.template_documents(rows.union(earlier)))


#: Portable SQL: a document's lines as rows of a list of materials.
_QUOTE = """CASE pos % 3 WHEN 0 THEN line ELSE 'Provide copies: Alpha certificate (a, b; (c, d) and e), Beta licence and Gamma report ' || doc_id || CASE WHEN pos % 4 = 1 THEN ', Gamma  report ' || doc_id ELSE '' END || '; ' || line END"""
_MATERIAL = {"name": "CASE WHEN pos % 5 = 1 THEN 'Beta licence' ELSE 'row ' || pos END", "quote": _QUOTE, "parent_name": "CASE WHEN pos % 13 = 2 THEN 'above' END", "source_kind": "CASE WHEN pos % 17 = 4 THEN 'index_table' ELSE 'text' END"}
_WORDS = splitting.Words(markers=(",", ";", " and "), terms=("certificate", "licence", "report", "the"), open_lists=("including but not limited to",), separators=(",", ";", " and "), opener=":")


@Q.plan(
    "p3_inline_children",
    rf"""WITH l AS (SELECT doc_id, unnest(range(0, len(s)))::INT AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
r AS (SELECT doc_id, pos, {", ".join(f"{v} AS {k}" for k, v in _MATERIAL.items())} FROM l),
k AS (SELECT *, regexp_replace(quote, '[\s\p{{Z}}]+', '', 'g') AS compact FROM r),
c AS (SELECT *, replace(CASE WHEN contains(quote, ':') THEN substr(quote, strpos(quote, ':') + 1) ELSE quote END, ' and ', chr(1)) AS body FROM k
  WHERE parent_name IS NULL AND source_kind <> 'index_table' AND length(compact) BETWEEN 18 AND 360 AND NOT contains(compact, 'includingbutnotlimitedto')
  AND (contains(quote, ',') OR contains(quote, ';') OR contains(quote, ' and ')) AND regexp_matches(quote || ' ' || name, 'certificate|licence|report|the')),
h AS (SELECT doc_id, pos, i, substr(body, i, 1) AS ch FROM (SELECT doc_id, pos, body, unnest(range(1, length(body) + 1)) AS i FROM c)),
s AS (SELECT *, sum(CASE WHEN regexp_matches(ch, '[(\[{{（【《]') THEN 1 WHEN regexp_matches(ch, '[)\]}}）】》]') THEN -1 ELSE 0 END) OVER w AS sum FROM h WINDOW w AS (PARTITION BY doc_id, pos ORDER BY i)),
d AS (SELECT *, sum - least(0, min(sum) OVER (PARTITION BY doc_id, pos ORDER BY i)) AS depth FROM s),
g AS (SELECT *, depth = 0 AND ch IN (',', ';', chr(1)) AS cut, sum(CASE WHEN depth = 0 AND ch IN (',', ';', chr(1)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY i) AS n FROM d),
p AS (SELECT doc_id, pos, n, trim(replace(string_agg(ch, '' ORDER BY i), chr(1), ' and '), ' ：:，,。；;、') AS child FROM g WHERE NOT cut GROUP BY 1, 2, 3),
m AS (SELECT p.doc_id, p.pos, n, child, regexp_replace(child, '[\s\p{{Z}}]+', '', 'g') AS key, name FROM p JOIN r ON r.doc_id = p.doc_id AND r.pos = p.pos WHERE regexp_matches(child, 'certificate|licence|report|the')),
o AS (SELECT * FROM m WHERE length(key) >= 2 AND key <> regexp_replace(name, '[\s\p{{Z}}]+', '', 'g') QUALIFY row_number() OVER (PARTITION BY doc_id, pos, key ORDER BY n) = 1)
SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos, n)::INT AS place, name, parent_name, level FROM
(SELECT doc_id, pos, -1 AS n, name, parent_name, 1 AS level FROM r UNION ALL SELECT doc_id, pos, n, child, name, 2 FROM o)""",
)
def inline_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that list materials, split outside brackets; the parts follow their row."""
    rows = lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", *[F.expr(v).alias(k) for k, v in _MATERIAL.items()], F.lit(1).alias("level"))
    return splitting.refined(rows, splitting.proposals(rows, "doc_id", "pos", _WORDS), "doc_id", "pos").select("doc_id", "pos", "place", "name", "parent_name", "level")


@Q.plan(
    "o2_reduced",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'error') AS status, arg_max(value, (ts, event_id)) FILTER (event_id % 5 <> 0) AS value,
coalesce(string_agg('w' || event_id || ' v' || event_id, ' ' ORDER BY ts, event_id) FILTER (event_type = 'error'), '') AS warnings FROM events GROUP BY 1""",
)
def reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' states from their events, of which every third comes twice: the last status and value that were told, and all warnings in order."""
    told = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", F.expr("CASE WHEN event_type <> 'error' THEN event_type END AS status"), F.expr("CASE WHEN event_id % 5 <> 0 THEN value END AS value"),
        F.expr("CASE WHEN event_type = 'error' THEN array('w' || event_id, 'v' || event_id) END AS warnings"),
    )
    state = reducers.reduced(told.union(told.where("event_id % 3 = 0")), "user_id", "ts", "event_id", ("status", "value"), ("warnings",))
    return state.withColumn("warnings", F.array_join("warnings", " "))
