"""Queries by DataFrame operators: retrieval, sections, text keys, trees, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions import values as V
from docquarry.operators import merging, retrieval, sections, trees
from docquarry.plans.query import Catalog, table
from docquarry.sources.readers import lines

Q = Catalog()


@Q.plan("retrieval_bm25_topk", retrieval.ORACLE)
def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return retrieval.hybrid_rank(queries, table(spark, sf_dir, "documents").select("doc_id", "text"))


@Q.plan("d15_corpus_stats", "WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[ \\n]+')) AS token FROM documents) SELECT token, count(*) AS df FROM w WHERE token <> '' GROUP BY token")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("text"), "[ \n]+"))
    return table(spark, sf_dir, "documents").select(F.explode(words).alias("token")).where("token <> ''").groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@Q.plan("a1_line_scan", "SELECT doc_id, i - 1 AS pos, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a block stream: signup, view and click are headings of levels 1 to 3, others body."""
    level = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).otherwise(0)
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), pos.alias("pos"), level.alias("level"))


_H = "h AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 0 END AS level FROM events)"


@Q.plan("e2_heading_parent", f"WITH {_H} SELECT a.doc_id, a.pos, a.level, max(b.pos) AS parent_pos FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level > 0 AND (a.level = 0 OR b.level < a.level) GROUP BY 1, 2, 3")
def heading_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.parents(headings(spark, sf_dir))


@Q.plan("e4_section_end", f"WITH {_H}, m AS (SELECT doc_id, max(pos) + 1 AS last FROM h GROUP BY 1) SELECT a.doc_id, a.pos, a.level, CASE WHEN a.level > 0 THEN coalesce(min(b.pos), any_value(m.last)) END AS end_pos FROM h a JOIN m USING (doc_id) LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.level BETWEEN 1 AND a.level GROUP BY 1, 2, 3")
def section_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.ends(headings(spark, sf_dir))


@Q.plan(
    "e3_chapter_ids",
    f"""WITH RECURSIVE {_H}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM h WHERE level > 0),
f AS (SELECT doc_id, k, pos, list_transform(range(0, level), lambda j: 1) AS c FROM k WHERE k = 1
  UNION ALL SELECT k.doc_id, k.k, k.pos, list_concat(list_transform(range(1, k.level), lambda j: coalesce(f.c[j], 1)), [coalesce(f.c[k.level], 0) + 1]) FROM f JOIN k ON k.doc_id = f.doc_id AND k.k = f.k + 1)
SELECT h.doc_id, h.pos, h.level, array_to_string(f.c, '.') AS chapter_id FROM h LEFT JOIN f ON f.doc_id = h.doc_id AND f.pos = h.pos""",
)
def chapter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.chapter_ids(headings(spark, sf_dir))


@Q.plan("e19_runs", "WITH f AS (SELECT event_id, user_id, event_type = 'view' AS flag, ts FROM events) SELECT event_id, CASE WHEN flag THEN sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) END::BIGINT AS run_id FROM f")
def view_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "view").alias("flag"), F.struct("ts", "event_id").alias("at"))
    return sections.runs(rows, "flag", "user_id", "at").select("event_id", "run_id")


@Q.plan("h1_compact", "SELECT doc_id, regexp_replace(text, '[\\s\\p{Z}]+', '', 'g') AS key FROM documents")
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.compact(F.col("text")).alias("key"))


@Q.plan("h3_title_clean", r"SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(trim(line), '^(?:[0-9]+(?:[.][0-9]+)*[.)、]?|[(][0-9a-z]{1,3}[)]|[-*•])[ ]*', ''), '[ .…]{2,}[0-9]+$', '')), '^[.,;:]+|[.,;:]+$', '', 'g') AS title FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_title(F.substring_index("text", "\n", 1)).alias("title"))


@Q.plan("h4_match_key", "SELECT c_custkey, translate(lower(c_name), ' #-_.,', '') AS key FROM customer")
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.translate(T.match_key(F.col("c_name")), "#", "").alias("key"))


@Q.plan("h5_heading_level", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT level, count(*) AS n FROM (SELECT CASE WHEN length(line) > 80 OR (length(line) BETWEEN 31 AND 80 AND regexp_matches(line, '[.;!?。；！？]$')) THEN 0 WHEN regexp_matches(line, '^(Chapter|CHAPTER) [0-9]|^第[0-9一二三四五六七八九十]+章') THEN 1 WHEN regexp_matches(line, '^[一二三四五六七八九十]+、|^[0-9]+[.)]? ') THEN 2 WHEN regexp_matches(line, '^[(（][0-9一二三四五六七八九十]+[)）]') THEN 3 WHEN regexp_matches(line, '^[0-9]+[.][0-9]+[.)]? ') THEN 2 WHEN regexp_matches(line, '^[0-9]+[.][0-9]+[.][0-9]+[.)]? ') THEN 3 WHEN regexp_matches(line, '^[0-9]+([.][0-9]+)+[.)]? ') THEN 4 ELSE 0 END AS level FROM l) GROUP BY 1")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).groupBy(T.heading_level(F.col("line")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@Q.plan("h6_tokens", "SELECT item_id, count(DISTINCT t) AS n FROM (SELECT item_id, w AS t FROM (SELECT item_id, unnest(string_split_regex(translate(text, ' -_/()、：:，。（）', '             '), '[ \\t\\n\\r]+')) AS w FROM benchmark) WHERE w <> '' UNION ALL SELECT item_id, substr(w, i, n) FROM (SELECT item_id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM (SELECT item_id, unnest(string_split_regex(translate(text, ' -_/()、：:，。（）', '             '), '[ \\t\\n\\r]+')) AS w FROM benchmark), (VALUES (2), (3), (4)) AS l(n) WHERE length(w) >= n)) GROUP BY item_id")
def token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(T.grams(F.col("text"))).cast("long").alias("n"))


@Q.plan("h12_doubled", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.regexp_replace("c_mktsegment", "(.)", "$1$1")
    return table(spark, sf_dir, "customer").select("c_custkey", T.collapse_doubled(twice).alias("segment"))


@Q.plan("i1_dates", "SELECT o_orderkey, try_strptime('20' || right(CAST(1900 + o_orderkey % 100 AS VARCHAR), 2) || '-' || CAST(1 + o_orderkey % 14 AS VARCHAR) || '-30', '%Y-%m-%d')::DATE AS d FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.lit("due 20"), F.right((1900 + F.col("o_orderkey") % 100).cast("string"), F.lit(2)), F.lit("/"), (1 + F.col("o_orderkey") % 14).cast("string"), F.lit("-30 or later"))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.first_date(written).alias("d"))


@Q.plan("j10_points", "SELECT p_partkey, (p_size || '')::DOUBLE AS points FROM part")
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", V.points(F.concat(F.lit("worth "), F.col("p_size").cast("string"), F.lit(" points"))).alias("points"))


@Q.plan("j11_amount", "SELECT s_suppkey, abs(round(s_acctbal, 2)) AS amount FROM supplier")
def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", V.amount(F.concat(F.lit("CNY "), F.abs(F.round("s_acctbal", 2)).cast("decimal(18,2)").cast("string"))).alias("amount"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as one tree."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("long").alias("pos"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.col("n_nationkey").cast("long"), "n_name")
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), "s_suppkey", "s_name")
    return r.union(n).union(s)


_TREE = "p AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier), t AS (SELECT id, 1 AS level, name AS path FROM p WHERE parent_id IS NULL UNION ALL SELECT p.id, t.level + 1, t.path || ' / ' || p.name FROM p JOIN t ON p.parent_id = t.id)"


@Q.plan("l1_flatten_path", f"WITH RECURSIVE {_TREE} SELECT id, level, path, id NOT IN (SELECT parent_id FROM p WHERE parent_id IS NOT NULL) AS is_leaf FROM t")
def flatten_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.flatten(places(spark, sf_dir)).select("id", "level", "path", "is_leaf")


@Q.plan("l4_remove_subtree", "SELECT 'r' || r_regionkey AS id FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def remove_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.without_subtree(places(spark, sf_dir), spark.sql("SELECT 'r2' AS id")).select("id")


@Q.plan("e1_renumber", "SELECT 'r' || r_regionkey AS id, row_number() OVER (ORDER BY r_regionkey)::VARCHAR AS number FROM region UNION ALL SELECT 'n' || n_nationkey, (SELECT count(*) FROM region x WHERE x.r_regionkey <= n_regionkey)::VARCHAR || '.' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) FROM nation")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = places(spark, sf_dir).where("id NOT LIKE 's%'")
    own = nodes.withColumn("name", F.row_number().over(Window.partitionBy("parent_id").orderBy("pos")).cast("string"))
    return trees.flatten(own).select("id", F.replace("path", F.lit(" / "), F.lit(".")).alias("number"))


@Q.plan("d6_conflict_rows", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS vals, array_to_string(list_sort(list(o_orderkey))[1:8], ',') AS occ FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def conflict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merging.conflicts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")
    return found.select("o_custkey", F.array_join("values", ",").alias("vals"), F.array_join(F.transform("occurrences", lambda x: x.cast("string")), ",").alias("occ"))
