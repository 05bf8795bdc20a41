"""Payloads of loosely written lists, made from orders and their lines, walked and made uniform; each counterpart is written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import payloads
from docquarry.plans.query import Catalog, table

Q = Catalog()

#: (list, default of mandatory, of required, of severity): a row for each normaliser.
RULES = [
    ("composition", True, True, "normal"), ("format", True, True, "normal"), ("base_info", False, False, "low"), ("timeline", True, False, "normal"), ("qualifications", True, True, "high"),
    ("technical", True, False, "normal"), ("invalidation", True, True, "fatal"), ("materials", True, True, "normal"),
]

#: An item by the line's number: a text, an object, null, nested lists, a number, an object with wrong types, an object that bears its value in another field.
_ITEM = """CASE l_linenumber
  WHEN 1 THEN '"line ' || l_partkey || '"'
  WHEN 2 THEN '{"value": "part ' || l_partkey || '", "quote": "q' || l_suppkey || '", "mandatory": ' || CASE WHEN l_partkey % 2 = 0 THEN 'false' ELSE '"yes"' END || ', "severity": "HIGH"}'
  WHEN 3 THEN 'null'
  WHEN 4 THEN '[["a' || l_partkey || '", ""], {"name": "b", "required": "no"}, [[' || l_suppkey || ']], []]'
  WHEN 5 THEN '' || l_partkey
  WHEN 6 THEN '{"value": {"deep": [1, {"x": null}]}, "text": "t' || l_partkey || '", "mandatory": [1], "severity": 5}'
  ELSE '{"quote": "no value ' || l_partkey || '", "more": {"k": true}}' END"""
_LIST = "CASE l_partkey % 8 " + " ".join(f"WHEN {i} THEN '{r[0]}'" for i, r in enumerate(RULES)) + " END"
#: Portable SQL for o_orderkey, payload: an object of lists, each list's items by line number, then text; every ninth order has a text that is no JSON.
_PAYLOADS = f"""
SELECT o AS o_orderkey, CASE WHEN o % 9 = 4 THEN 'no JSON {{' ELSE '{{' || string_agg('"' || name || '": ' || CASE WHEN n = 1 AND o % 2 = 0 THEN items ELSE '[' || items || ']' END, ', ') || ', "other": {{"deep": [{{"x": ' || o || '}}]}}}}' END AS payload
FROM (SELECT l_orderkey AS o, {_LIST} AS name, string_agg(item, ', ' ORDER BY l_linenumber, item) AS items, count(*) AS n FROM (SELECT *, {_ITEM} AS item FROM lineitem) GROUP BY 1, 2) x GROUP BY o"""


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, payload. Lines are shuffled once, as numbers; their items are written where an order's lines are together."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", "l_partkey", "l_suppkey").repartition("o")
    rows = lines.select("o", F.expr(_LIST).alias("name"), "l_linenumber", F.expr(_ITEM).alias("item"))
    lists = rows.groupBy("o", "name").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "item"))).alias("x"))
    lists = lists.select("o", "name", F.size("x").alias("n"), F.array_join(F.transform("x", lambda x: x["item"]), ", ").alias("items"))
    field = F.concat(F.lit('"'), "name", F.lit('": '), F.when((F.col("n") == 1) & (F.col("o") % 2 == 0), F.col("items")).otherwise(F.concat(F.lit("["), "items", F.lit("]"))))
    whole = lists.select("o", field.alias("f")).groupBy("o").agg(F.array_join(F.collect_list("f"), ", ").alias("f"))
    text = F.concat(F.lit("{"), "f", F.lit(', "other": {"deep": [{"x": '), F.col("o").cast("string"), F.lit("}]}}"))
    return whole.select(F.col("o").alias("o_orderkey"), F.when(F.col("o") % 9 == 4, "no JSON {").otherwise(text).alias("payload"))


@Q.plan(
    "k11_walk",
    f"""WITH p AS ({_PAYLOADS}), j AS (SELECT o_orderkey, payload::JSON AS v FROM p WHERE json_valid(payload))
SELECT o_orderkey, replace(fullkey, '"', '') AS path, CASE WHEN type = 'NULL' THEN 'null' ELSE 'scalar' END AS kind, json_extract_string(atom, '$') AS value FROM j, json_tree(v) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""",
)
def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar and null of every payload with its path, however deep."""
    parsed = made(spark, sf_dir).select("o_orderkey", F.try_parse_json("payload").alias("v"))
    found = payloads.walk(parsed, "v")
    return found.select("o_orderkey", "path", "kind", F.when(F.col("kind") == "scalar", F.variant_get("value", "$", "string")).alias("value"))


_RULES = ", ".join(f"('{n}', {m}, {r}, '{s}')" for n, m, r, s in RULES)


@Q.plan(
    "k2_normalised",
    f"""WITH RECURSIVE p AS ({_PAYLOADS}), j AS (SELECT o_orderkey, payload::JSON AS v FROM p WHERE json_valid(payload)),
rules(list, m, r, s) AS (VALUES {_RULES}),
w AS (SELECT o_orderkey, list, json_extract(v, '$.' || list) AS v, []::INT[] AS places FROM j, rules WHERE json_extract(v, '$.' || list) IS NOT NULL
  UNION ALL SELECT o_orderkey, list, json_extract(v, '$[' || i || ']'), list_append(places, i::INT) FROM (SELECT *, unnest(range(0, json_array_length(v)::BIGINT)) AS i FROM w WHERE json_type(v) = 'ARRAY')),
f AS (SELECT w.*, json_type(v) AS kind FROM w WHERE json_type(v) <> 'ARRAY'),
t AS (SELECT *, CASE WHEN kind = 'OBJECT' THEN coalesce(CASE WHEN json_type(v, '$.value') NOT IN ('OBJECT', 'ARRAY') THEN nullif(trim(v->>'$.value'), '') END, nullif(trim(v->>'$.name'), ''), nullif(trim(v->>'$.text'), '')) WHEN kind <> 'NULL' THEN nullif(v->>'$', '') END AS atom FROM f)
SELECT o_orderkey, t.list, (row_number() OVER (PARTITION BY o_orderkey, t.list ORDER BY places) - 1)::INT AS pos, atom, coalesce(CASE WHEN kind = 'OBJECT' THEN v->>'$.quote' END, atom) AS quote,
  CASE WHEN kind = 'OBJECT' AND v->>'$.mandatory' IN ('true', 'yes') THEN true WHEN kind = 'OBJECT' AND v->>'$.mandatory' IN ('false', 'no') THEN false ELSE m END AS mandatory,
  CASE WHEN kind = 'OBJECT' AND v->>'$.required' = 'no' THEN false ELSE r END AS required, coalesce(CASE WHEN kind = 'OBJECT' THEN lower(v->>'$.severity') END, s) AS severity
FROM t JOIN rules ON rules.list = t.list WHERE atom IS NOT NULL""",
)
def normalised_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads' eight lists as uniform items."""
    return payloads.normalised(made(spark, sf_dir), "o_orderkey", "payload", RULES)
