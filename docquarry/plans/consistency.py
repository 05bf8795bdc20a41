"""Consistency of what projects' sections say: customers as projects, their orders as sections; the counterpart is written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import facts
from docquarry.plans.query import Catalog, table

Q = Catalog()

RULES = [
    ("amount", "quote", r"Quote: ([0-9.]+)"), ("number", "project", r"Ref\.? (PRJ-[0-9]+)"), ("party", "buyer", r"Buyer: ([A-Za-z#0-9]+)"), ("role", "manager", r"Manager: ([A-Z][a-z]+)"),
    ("date", "opening", r"opening on ([0-9]{4}-[0-9]{2}-[0-9]{2})"), ("date", "submission", r"submission on ([0-9]{4}-[0-9]{2}-[0-9]{2})"), ("date", "award", r"award on ([0-9]{4}-[0-9]{2}-[0-9]{2})"), ("date", "service", r"service on ([0-9]{4}-[0-9]{2}-[0-9]{2})"),
]
ORDER = [("submission", "opening"), ("award", "service")]
#: Portable SQL for what a section says, given `day` (an ISO date).
_TEXT = """'Quote: ' || CASE WHEN o_orderkey % 31 = 0 THEN '12.5' ELSE '' || (10 + o_custkey % 3) END || ' EUR. Ref. PRJ-' || CASE WHEN o_orderkey % 23 = 0 THEN 7 ELSE o_custkey END || '. Buyer: C' || CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE '' || o_custkey END
  || '. Manager: ' || CASE o_orderkey % 37 WHEN 0 THEN 'Ann' ELSE 'Bo' END || ', ' || CASE o_orderkey % 4 WHEN 0 THEN 'opening' WHEN 1 THEN 'submission' WHEN 2 THEN 'award' ELSE 'service' END || ' on ' || CASE WHEN o_orderkey % 11 = 0 THEN '2024-02-30' ELSE day END || '.'"""


def _lists(rules) -> str:
    return " UNION ALL ".join(f"SELECT project, '{k}' AS kind, '{key}' AS key, section, unnest(x) AS value, generate_subscripts(x, 1) - 1 AS place FROM (SELECT project, section, regexp_extract_all(text, '{p}', 1) AS x FROM s)" for k, key, p in rules)


@Q.plan(
    "m13_report",
    f"""WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders), s AS (SELECT o_custkey AS project, o_orderkey AS section, {_TEXT} AS text FROM o),
f AS (SELECT * FROM ({_lists(RULES)}) WHERE kind <> 'date' OR try_cast(value AS DATE) IS NOT NULL),
lk AS (SELECT o_custkey AS project, 'submission' AS key, min(day) AS value FROM o WHERE o_custkey % 4 = 0 GROUP BY 1),
v AS (SELECT project, kind, key, value, min(struct_pack(section := section, place := place)) AS first FROM f GROUP BY ALL),
one AS (SELECT project, kind AS conflict, key, value, first FROM v WHERE kind <> 'date' QUALIFY count(*) OVER (PARTITION BY project, kind, key) > 1),
off AS (SELECT v.project, 'locked' AS conflict, v.key, v.value, v.first FROM v JOIN lk ON lk.project = v.project AND lk.key = v.key WHERE v.kind = 'date' AND v.value <> lk.value),
said AS (SELECT project, key, arg_min(value, struct_pack(section := section, place := place)) AS value FROM f WHERE kind = 'date' GROUP BY ALL),
d AS (SELECT coalesce(said.project, lk.project) AS project, coalesce(said.key, lk.key) AS key, coalesce(lk.value, said.value) AS value FROM said FULL JOIN lk ON lk.project = said.project AND lk.key = said.key)
SELECT project, conflict, key, string_agg(value, ',' ORDER BY value) AS vals, string_agg(first.section || ':' || first.place, ' ' ORDER BY first) AS places FROM (SELECT * FROM one UNION ALL SELECT * FROM off) GROUP BY 1, 2, 3
UNION ALL SELECT a.project, 'order', a.key || '<' || b.key, a.value || ',' || b.value, '' FROM d a JOIN d b ON a.project = b.project AND ((a.key = 'submission' AND b.key = 'opening') OR (a.key = 'award' AND b.key = 'service')) AND b.value < a.value""",
)
def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer's orders say, with the first day of every fourth customer locked as the day of submission."""
    orders = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    sections = orders.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("section"), F.expr(_TEXT).alias("text"))
    locked = orders.where("o_custkey % 4 = 0").groupBy(F.col("o_custkey").alias("project")).agg(F.min("day").alias("value")).select("project", F.lit("submission").alias("key"), "value")
    return facts.report(sections, RULES, locked, ORDER)
