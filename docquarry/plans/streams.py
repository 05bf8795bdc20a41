"""Windows and sessions as batch queries over the same operators that streams use; outlines and HTML as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.plans.query import Catalog, table
from docquarry.sources import html, readers, sinks
from docquarry.streaming import events

Q = Catalog()


@Q.plan("z_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.windowed(table(spark, sf_dir, "events"))


@Q.plan(
    "z_sessions",
    "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM b GROUP BY user_id, s",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(table(spark, sf_dir, "events"))


@Q.plan("a15_html_headings", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)', 1), '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g'), '[ \t\n\r]+', ' ', 'g')) AS title FROM pages")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_blocks(table(spark, sf_dir, "pages")).where("level = 1").select("page_id", F.col("text").alias("title"))


@Q.plan("a15_html_blocks", html.ORACLE)
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_blocks(table(spark, sf_dir, "pages"))


@Q.plan(
    "a15_html_shape",
    r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[a-z][^>]*>')) AS tok FROM pages)
    SELECT page_id, count(*) AS elements, count(*) FILTER (starts_with(tok, '<li')) AS items FROM t WHERE NOT starts_with(tok, '<!') GROUP BY page_id""",
)
def html_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements and list items of each page's tree."""
    nodes = html.html_nodes(table(spark, sf_dir, "pages")).where("tag IS NOT NULL")
    return nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("tag") == "li").alias("items"))


@Q.plan("a13_outline", "WITH n AS (SELECT n_regionkey AS r, n_nationkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) SELECT r AS doc_id, i::INT AS pos, '1.' || i AS number, n_name AS name, 0 AS parent_pos FROM n UNION ALL SELECT r_regionkey, 0, '1', r_name, NULL FROM region")
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as pasted outlines of their nations."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    rows = F.array_join(F.transform("x", lambda x, i: F.concat(F.lit("1."), (i + 1).cast("string"), F.lit(" "), x["n_name"])), "\n")
    text = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("1 "), "r_name", F.lit("\n"), rows).alias("text"))
    return readers.outline(text)


@Q.plan("m2_markdown", "SELECT n_regionkey AS doc_id, string_agg('# ' || n_name || chr(10) || chr(10) || 'nation ' || n_nationkey, chr(10) || chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1")
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("pos"), F.lit(1).alias("level"), F.col("n_name").alias("title"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("content"))
    return sinks.markdown(rows)


# Grouping sets, set operations, pivots
Q.sql("z_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM @lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
Q.sql("z_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM @orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
Q.sql("z_intersect", "SELECT c_nationkey AS k FROM @customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM @supplier WHERE s_acctbal > 5000")


@Q.plan("z_pivot", "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as columns; the kinds are named, so no pass looks for them."""
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).count()
    return wide.na.fill(0).select("user_id", F.col("view").alias("views"), F.col("click").alias("clicks"), F.col("purchase").alias("purchases"))


@Q.plan("z_sliding", "SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY ALL")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day, every twelve hours."""
    w = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day", "12 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")
