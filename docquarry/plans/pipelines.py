"""Longer plans: evidence retrieval, block ranges, folds, tables in texts, upserts, tree edits."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import folds
from docquarry.plans.query import Catalog, table
from docquarry.runtime import ship

Q = Catalog()
sql = Q.sql


def ratio_udf(spark: SparkSession):
    """Similarity of two strings by matching blocks, 0 to 1: no built-in computes it, so it runs on Arrow batches."""
    ship(spark)

    @F.pandas_udf("double")
    def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])

    return ratio


def _parts(a: str, n: int):
    """Distinct parts of n characters of column a, each with its number among equal ones: (part, occurrence)."""
    every = f"transform(sequence(1, length({a}) - {n - 1}), i -> substr({a}, i, {n}))"
    return F.expr(f"transform({every}, (g, i) -> struct(g AS g, size(filter(slice({every}, 1, i + 1), x -> x = g)) AS k))")


def title_candidates(names: DataFrame) -> DataFrame:
    """Of distinct (brand, a): p_brand, a, b, in both directions, all pairs of which one holds the other or whose ratio can reach 0.9.

    A held name of 4 or more characters shares its rarest part of 4 with its holder. Names with a ratio of 0.9 differ in at most
    a tenth of their characters, so at most 0.364 of a name's pairs of neighbours are missing in the other: ordered by
    rarity, their first 0.364 length + 1 pairs meet.
    """

    def listed(n: int) -> DataFrame:
        parts = names.where(F.length("a") >= n).select("p_brand", "a", F.explode(_parts("a", n)).alias("part"))
        return parts.join(parts.groupBy("p_brand", "part").agg(F.count(F.lit(1)).alias("n")), ["p_brand", "part"])

    fours = listed(4)
    rarest = fours.groupBy("p_brand", "a").agg(F.min(F.struct("n", "part"))["part"]["g"].alias("g")).select("p_brand", "g", F.col("a").alias("held"))
    holders = fours.select("p_brand", F.col("part.g").alias("g"), F.col("a").alias("holder")).distinct()
    holds = rarest.join(holders, ["p_brand", "g"]).where("held <> holder AND contains(holder, held)")
    ordered = listed(2).groupBy("p_brand", "a").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("o"))
    prefix = ordered.select("p_brand", "a", F.explode(F.expr("slice(o, 1, cast(floor(0.364 * length(a)) AS int) + 1)")).alias("x")).select("p_brand", "a", "x.part")
    close = prefix.join(prefix.select("p_brand", "part", F.col("a").alias("b")), ["p_brand", "part"]).where("a < b AND 20 * least(length(a), length(b)) >= 9 * (length(a) + length(b))")
    both = holds.select("p_brand", F.col("held").alias("a"), F.col("holder").alias("b")).unionByName(close.select("p_brand", "a", "b"))
    return both.unionByName(both.select("p_brand", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


@Q.plan("c7_best_title")
def best_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names to the nearest other name of the brand: exact 100, containment 86 less the gap, else 80 times the ratio from 0.9."""
    return nearest_titles(spark, table(spark, sf_dir, "part"))


def nearest_titles(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """p_partkey, other, score; names of fewer than 3 characters match none, and are held by none below 4. The smallest other key wins ties."""
    ratio = ratio_udf(spark)
    p = parts.select("p_partkey", "p_brand", T.match_key(F.col("p_name")).alias("a")).where("length(a) >= 3")
    names = p.groupBy("p_brand", "a").agg(F.array_sort(F.collect_set("p_partkey")).alias("ks")).select("p_brand", "a", F.slice("ks", 1, 2).alias("ks"))
    named = title_candidates(names.select("p_brand", "a")).join(names.select("p_brand", F.col("a").alias("b"), F.get("ks", F.lit(0)).alias("other")), ["p_brand", "b"])
    gap = F.least(F.abs(F.length("a") - F.length("b")), F.lit(12))
    held = (F.least(F.length("a"), F.length("b")) >= 4) & (F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")))
    rated = named.withColumn("r", ratio(F.col("a"), F.col("b")))
    scored = rated.withColumn("score", F.when(held, 86.0 - gap).otherwise(F.when(F.col("r") >= 0.9, 80 * F.col("r")).otherwise(0.0))).where("score >= 60")
    best = scored.groupBy("p_brand", "a").agg(F.max(F.struct("score", (-F.col("other")).alias("o"))).alias("best"))
    found = p.join(names, ["p_brand", "a"]).join(best, ["p_brand", "a"], "left")
    same = F.when(F.size("ks") > 1, F.when(F.get("ks", F.lit(0)) == F.col("p_partkey"), F.get("ks", F.lit(1))).otherwise(F.get("ks", F.lit(0))))
    out = found.select("p_partkey", F.coalesce(same, -F.col("best.o")).alias("other"), F.when(same.isNotNull(), 100.0).otherwise(F.round("best.score", 4)).alias("score"))
    return out.where("other IS NOT NULL")


@Q.plan("j4_candidate_score")
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation questions against answers of the same conversation: 0.55 overlap, 0.2 ratio, 0.25 containment, all of whole texts."""
    return scored_answers(spark, table(spark, sf_dir, "conversations"))


def scored_answers(spark: SparkSession, c: DataFrame) -> DataFrame:
    """conv_id, turn, answer, score; containment counts either way, and an empty text holds or is held by none."""
    ratio = ratio_udf(spark)
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answer"), F.col("text").alias("a"))
    pairs = q.join(a, "conv_id").where("answer = turn + 1")
    qw, aw = F.array_distinct(T.words(F.lower("q"))), F.array_distinct(T.words(F.lower("a")))
    overlap = F.size(F.array_intersect(qw, aw)) / F.greatest(F.size(qw), F.lit(1))
    held = (F.length("q") > 0) & (F.length("a") > 0) & (F.col("a").contains(F.col("q")) | F.col("q").contains(F.col("a")))
    score = 0.55 * overlap + 0.2 * ratio(F.col("q"), F.col("a")) + 0.25 * held.cast("int")
    return pairs.select("conv_id", "turn", "answer", F.round(score, 4).alias("score"))


@Q.plan("e13_greedy_batches", 'WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations), f AS (SELECT conv_id, turn, k, n AS size, 0 AS batch FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN f.size > 0 AND f.size + t.n > 2000 THEN t.n ELSE f.size + t.n END, f.batch + (f.size > 0 AND f.size + t.n > 2000)::INT FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1) SELECT conv_id, turn, batch FROM f')
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation dealt to batches in order, a batch closing when the next turn would pass 2000 characters: a fold."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return folds.batched(turns, "conv_id", "turn", "n", 2000)


@Q.plan("e14_budget_selection", "WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY (role <> 'user')::INT, length(text), turn) AS k FROM conversations), f AS (SELECT conv_id, turn, k, n AS size, true AS took FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN f.size + t.n <= 1500 THEN f.size + t.n ELSE f.size END, f.size + t.n <= 1500 FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1) SELECT conv_id, turn FROM f WHERE took")
def budget_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation, turns by role and size while they fit in 1500 characters; the first is always taken: a fold."""
    rank = F.when(F.col("role") == "user", 0).otherwise(1)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", rank.alias("p"), F.length("text").alias("n"))
    return folds.within_budget(turns, "conv_id", ["p", "n", "turn"], "turn", "n", 1500)


@Q.plan("j6_source_ask", "WITH t AS (SELECT DISTINCT conv_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 8))) AS term FROM conversations WHERE role = 'user' AND turn <= 1), d AS (SELECT conv_id, turn, lower(text) AS x FROM conversations WHERE role = 'assistant') SELECT t.conv_id, d.turn, sum(least((length(x) - length(replace(x, term, ''))) // length(term), 4) * 2)::BIGINT AS score FROM t JOIN d ON t.conv_id = d.conv_id AND contains(x, term) GROUP BY 1, 2")
def source_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's long words scored in the answers of its conversation, each word's count capped at 4."""
    c = table(spark, sf_dir, "conversations")
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 8))
    t = c.where("role = 'user' AND turn <= 1").select("conv_id", F.explode(terms).alias("term")).distinct()
    d = c.where("role = 'assistant'").select("conv_id", "turn", F.lower("text").alias("x"))
    tf = F.floor((F.length("x") - F.length(F.replace("x", "term"))) / F.length("term"))
    return t.join(d, "conv_id").where(F.col("x").contains(F.col("term"))).groupBy("conv_id", "turn").agg(F.sum(F.least(tf, F.lit(4)) * 2).cast("long").alias("score"))


@Q.plan(
    "t10_fragments",
    r"""WITH k AS (SELECT item_id, regexp_replace(text, '[\s\p{Z}]+', '', 'g') AS key, list_filter(list_transform(string_split_regex(text, '[.,;:!?\n]+'), lambda p: regexp_replace(p, '[\s\p{Z}]+', '', 'g')), lambda p: length(p) >= 4) AS parts FROM benchmark WHERE text IS NOT NULL),
e AS (SELECT item_id, unnest(x) AS fragment, generate_subscripts(x, 1) AS i FROM (SELECT item_id, list_concat([left(key, 96), left(key, 64), left(key, 36)], parts[:48]) AS x FROM k)),
d AS (SELECT item_id, fragment, min(i) AS i FROM e GROUP BY item_id, fragment)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY length(fragment) DESC, i) - 1)::INT AS pos, fragment FROM d""",
)
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search fragments of quotes: the compact text at 96, 64 and 36 characters and its longer parts, distinct, longest first."""
    key = T.compact(F.col("text"))
    parts = F.filter(F.split("text", "[.,;:!?\n]+"), lambda p: F.length(T.compact(p)) >= 4)
    every = F.array_distinct(F.concat(F.array(*[F.left(key, F.lit(n)) for n in (96, 64, 36)]), F.slice(F.transform(parts, T.compact), 1, 48)))
    by_length = F.array_sort(every, lambda a, b: F.length(b) - F.length(a))
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(by_length).alias("pos", "fragment"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


@Q.plan("s3_upsert", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    new = customers.where("c_acctbal < 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"))
    return upsert(customers.select("c_custkey", "c_mktsegment"), new, "c_custkey")


sql("s4_backfill", "SELECT c_custkey, CASE WHEN c_nationkey < 3 THEN 'BUILDING' ELSE c_mktsegment END AS segment FROM @customer")
sql("t11_visible_selection", "SELECT o_orderkey FROM @orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM @customer WHERE c_acctbal > 0)")
sql("h9_stopped_tokens", "SELECT p_partkey, array_join(filter(split(lower(p_name), ' '), x -> length(x) >= 2 AND x NOT IN ('the', 'of')), ' ') AS tokens FROM @part", "SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 2 AND x NOT IN ('the', 'of')), ' ') AS tokens FROM part")
sql("h11_alias_test", "SELECT doc_id FROM @documents WHERE lower(text) LIKE '%ing%' OR lower(text) LIKE '%ung%'")
sql("h16_sanitiser", "SELECT doc_id, replace(replace(replace(text, 'technical_requirements', 'requirements'), 'source', 'origin'), '**', '') AS clean FROM @documents")
sql("j7_row_score", "SELECT o_orderkey, 30 * CAST(o_orderpriority LIKE '1%' AS INT) + 20 * CAST(o_totalprice > 100000 AS INT) - 10 * CAST(o_orderstatus = 'F' AS INT) AS score FROM @orders")
sql("k1_atoms", "SELECT event_id, event_type AS value, coalesce(nullif(event_type, ''), 'none') AS quote FROM @events WHERE event_type IS NOT NULL AND event_type <> ''")
sql("k2_list_defaults", "SELECT doc_id, coalesce(quality, 1) AS mandatory, coalesce(toxic, 0) AS severity FROM @labels")
sql("k6_search_text", "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type) AS search FROM @part")
sql("m10_draft", "SELECT s_suppkey, concat('Supplier ', s_name, ' of nation ', CAST(s_nationkey AS STRING)) AS draft FROM @supplier")
sql("a16_range_text", "SELECT doc_id, left(text, 6000) AS content FROM @documents")
sql("a17_preview", "SELECT doc_id, left(text, 240) AS preview, length(text) - length(replace(text, '|', '')) AS bars FROM @documents")
sql("a7_dispatch", "SELECT page_id, CASE WHEN url LIKE '%.pdf' THEN 'pdf' WHEN url LIKE '%.docx' THEN 'docx' ELSE 'html' END AS reader FROM @pages")
