"""Predicates, scores, rankings and reports by lexicons and shapes, over lines of documents and the business tables.

Keyword rules run with English lexicons; each counterpart is written on its own from the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators.ranking import positions
from docquarry.operators.vectors import VectorIndex
from docquarry.plans.query import Catalog, table
from docquarry.runtime import join_small, spread
from docquarry.sources.readers import lines

Q = Catalog()
_LINES = "l AS (SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


def hit(c: Column) -> Column:
    return c.cast("int")


#: Section tags, in order, and the words of which any one gives the tag.
TAGS = {"scope": ("the", "then"), "score": ("ing",), "price": ("tion",), "format": ("|",), "legal": ("toxic", "worthless"), "time": ("at", "on"), "form": ("que", "der")}


@Q.plan("b13_section_routing", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{tag}' END" for tag, ws in TAGS.items()) + "], lambda x: x IS NOT NULL), ',') AS tags FROM documents")
def section_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tags of a section, in their order: a tag applies where any of its words stands in the whole text."""
    low = F.lower("text")
    rules = F.array(*[F.struct(F.lit(tag).alias("tag"), F.array(*map(F.lit, ws)).alias("words")) for tag, ws in TAGS.items()])
    tags = F.transform(F.filter(rules, lambda r: F.exists(r["words"], lambda w: low.contains(w))), lambda r: r["tag"])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


@Q.plan("b14_shape_predicates", f"WITH {_LINES} SELECT doc_id, pos, length(line) <= 40 AND NOT regexp_matches(line, '[.!?]$') AS heading, contains(line, '|') AS table_row, regexp_matches(line, '(^| )[A-Z][a-z]+ of the') AS titled, regexp_matches(line, '[.]{{3,}}|[0-9]$') AS toc, line = upper(line) AND line <> lower(line) AS capitals FROM l WHERE trim(line) <> ''")
def shape_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of lines: headings, table rows, titled parts, lines of a table of contents, capitals."""
    line = F.col("line")
    rows = lines(table(spark, sf_dir, "documents")).where(F.trim("line") != "")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), ((F.length(line) <= 40) & ~F.substring(line, -1, 1).isin(".", "!", "?")).alias("heading"), line.contains("|").alias("table_row"), line.rlike("(?:^| )[A-Z][a-z]+ of the").alias("titled"), (line.contains("...") | line.rlike("[0-9]$")).alias("toc"), ((line == F.upper(line)) & (line != F.lower(line))).alias("capitals"))


#: Words that begin another part, and words of which a list item has none.
STOPS, NOISE = ("Than", "Onin", "And"), ("worthless", "pathetic", "stupid")


@Q.plan("b15_line_predicates", f"WITH {_LINES} SELECT doc_id, pos, regexp_matches(rtrim(line), '[:,]$') AS intro, regexp_matches(ltrim(line), '^(Than|Onin|And)') AS stop, regexp_matches(line, '^[ ]*([0-9]+[.)]|[(][0-9a-z]+[)])') AS numbered, regexp_matches(line, '[(][^()]*[)]') AS grouped, regexp_matches(lower(line), 'worthless|pathetic|stupid') AS noise, length(line) > 120 OR line NOT SIMILAR TO '.*[A-Za-z].*' AS dirty FROM l WHERE trim(line) <> ''")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list's line may be: its intro, a stop, a numbered clause, a bracketed group, noise, or dirt."""
    line = F.col("line")
    rows = lines(table(spark, sf_dir, "documents")).where(F.trim("line") != "")
    stop = F.lit(False)
    for w in STOPS:
        stop = stop | F.ltrim(line).startswith(w)
    noise = F.exists(F.array(*map(F.lit, NOISE)), lambda w: F.lower(line).contains(w))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.right(F.rtrim(line), F.lit(1)).isin(":", ",").alias("intro"), stop.alias("stop"), F.ltrim(line).rlike(r"^(?:\d+[.)]|\([0-9a-z]+\))").alias("numbered"), line.rlike(r"\([^()]*\)").alias("grouped"), noise.alias("noise"), ((F.length(line) > 120) | ~line.rlike("[A-Za-z]")).alias("dirty"))


@Q.plan("b17_umbrella_guard", "SELECT doc_id FROM documents d WHERE n_chars <= 2000 OR NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = d.source AND x.lang = d.lang AND x.n_chars <= 2000)")
def umbrella_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts are dropped unless their group (source and language) has no others: counts per group, pre-aggregated, then joined."""
    docs = table(spark, sf_dir, "documents")
    rest = docs.where("n_chars <= 2000").select("source", "lang").distinct().withColumn("rest", F.lit(True))
    return docs.join(rest, ["source", "lang"], "left").where("n_chars <= 2000 OR rest IS NULL").select("doc_id")


@Q.plan("b18_invalid_names", f"WITH {_LINES}, n AS (SELECT doc_id, array_to_string(string_split(line, ' ')[1:3], ' ') AS name FROM l WHERE pos = 0) SELECT doc_id, name FROM n WHERE length(name) < 2 OR length(name) > 120 OR regexp_matches(name, '[.;!?][ ]|[.;!?]$') OR regexp_matches(lower(name), '(^| )(shall|must|that|which)( |$)')")
def invalid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three words that can't be a name: too short or long, with sentence punctuation, or with a clause's words."""
    name = F.col("name")
    clause = F.arrays_overlap(F.split(F.lower(name), " "), F.array(*map(F.lit, ("shall", "must", "that", "which"))))
    bad = (F.length(name) < 2) | (F.length(name) > 120) | F.exists(F.split(name, " "), lambda w: F.right(w, F.lit(1)).isin(".", ";", "!", "?")) | clause
    return table(spark, sf_dir, "documents").select("doc_id", F.substring_index(F.substring_index("text", "\n", 1), " ", 3).alias("name")).where(bad)


@Q.plan("c6_token_join", """WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 4))) AS w FROM benchmark), qn AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
d AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 4))) AS w FROM documents), dn AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT item_id, doc_id, count(*) AS common FROM q JOIN d USING (w) GROUP BY ALL)
SELECT item_id, doc_id, round(common / (qn.n + dn.n - common), 6) AS score FROM p JOIN qn USING (item_id) JOIN dn USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(common / (qn.n + dn.n - common), 6) DESC, doc_id) <= 5""")
def token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents most alike to each item by words of four letters and more: an equi-join on words, of which a document's are first cut to those asked for."""
    words = lambda t, k: t.select(k, F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) >= 4))).alias("w"))
    size = lambda t, k, n: t.select(k, F.size(F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) >= 4))).alias(n))
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    both = words(docs, "doc_id").join(words(items, "item_id"), "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("both"))
    scored = both.join(size(items, "item_id", "a"), "item_id").join(size(docs, "doc_id", "b"), "doc_id").withColumn("score", F.round(F.col("both") / (F.col("a") + F.col("b") - F.col("both")), 6))
    return scored.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).where("n <= 5").select("item_id", "doc_id", "score")


#: Names that mean the same.
ALIASES = {"edst": "threeain", "hein": "onesen"}


@Q.plan("c8_cover", """WITH q AS (SELECT item_id, lower(regexp_replace(text, '[ \\t\\r\\n.,]+', '', 'g')) AS q, text FROM benchmark), d AS (SELECT doc_id, lower(regexp_replace(text, '[ \\t\\r\\n.,]+', '', 'g')) AS x FROM documents),
a AS (SELECT item_id, doc_id FROM q JOIN d ON length(q) >= 4 AND contains(x, q)), w AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3))) AS w FROM benchmark),
t AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) <= 3), b AS (SELECT DISTINCT item_id, doc_id FROM t JOIN d ON contains(x, w)),
g AS (SELECT item_id, CASE WHEN w IN ('edst', 'threeain') THEN 0 WHEN w IN ('hein', 'onesen') THEN 1 END AS g FROM w), gi AS (SELECT DISTINCT item_id, g FROM g WHERE g IS NOT NULL), n AS (SELECT item_id, count(*) AS n FROM gi GROUP BY 1),
h AS (SELECT item_id, doc_id FROM gi JOIN d ON (g = 0 AND (contains(x, 'edst') OR contains(x, 'threeain'))) OR (g = 1 AND (contains(x, 'hein') OR contains(x, 'onesen'))) JOIN n USING (item_id) GROUP BY item_id, doc_id, n.n HAVING count(*) = n.n)
SELECT item_id, (SELECT count(*) FROM a WHERE a.item_id = q.item_id) AS whole, (SELECT count(*) FROM h WHERE h.item_id = q.item_id) AS by_alias, (SELECT count(*) FROM b WHERE b.item_id = q.item_id) AS by_token,
  (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM h UNION SELECT * FROM b) u WHERE u.item_id = q.item_id) AS covered_by FROM q""")
def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cover an item: they hold its whole text, else a name of each alias group it names, else one of its three longest words.

    Whole texts, names and words meet documents through a part that they begin with, not by comparing each with each.
    """
    squeeze = lambda c: F.lower(F.regexp_replace(c, "[ \t\r\n.,]+", ""))
    items = table(spark, sf_dir, "benchmark").select("item_id", squeeze("text").alias("q"), F.lower("text").alias("low"))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", squeeze("text").alias("x"))
    inside = F.col("x").contains(F.col("q"))
    whole = T.held_in(items.where("length(q) >= 4").select("item_id", "q"), "q", docs, "x", 4).where(inside).select("item_id", "doc_id")
    words = F.array_distinct(F.filter(F.regexp_extract_all("low", F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 3))
    longest = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("k"), w.alias("q")))), 1, 3)
    token = T.held_in(items.select("item_id", F.explode(longest).alias("t")).select("item_id", "t.q"), "q", docs, "x", 3).where(inside).select("item_id", "doc_id").distinct()
    names = [(g, n) for g, pair in enumerate(ALIASES.items()) for n in pair]
    groups = F.array_distinct(F.flatten(F.array(*[F.when(F.array_contains(words, n), F.array(F.lit(g))).otherwise(F.array().cast("array<int>")) for g, n in names])))
    asked = items.select("item_id", F.size(groups).alias("n"), F.explode(groups).alias("g"))
    said = docs.select("doc_id", F.explode(F.array_distinct(F.filter(F.array(*[F.when(F.col("x").contains(n), F.lit(g)) for g, n in names]), lambda g: g.isNotNull()))).alias("g"))
    alias = asked.join(said, "g").groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("m")).where("m = n").select("item_id", "doc_id")
    count = lambda t, name: t.groupBy("item_id").agg(F.count(F.lit(1)).alias(name))
    out = items.select("item_id")
    for t, name in ((whole, "whole"), (alias, "by_alias"), (token, "by_token"), (whole.union(alias).union(token).distinct(), "covered_by")):
        out = out.join(count(t, name), "item_id", "left")
    return out.na.fill(0)


@Q.plan("c20_quote_block", """WITH f AS (SELECT item_id, trim(f) AS f FROM (SELECT item_id, unnest(string_split_regex(text, '[.\\n]')) AS f FROM benchmark) WHERE length(trim(f)) >= 6), l AS (SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
h AS (SELECT item_id, doc_id, pos, 1000 + least(max(length(f)), 200) AS score FROM f JOIN l ON contains(line, f) GROUP BY ALL)
SELECT item_id, doc_id, pos, score FROM h WHERE score >= 1006 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, pos) = 1""")
def quote_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds an item's longest fragment (its sentences of six characters and more); fragments meet lines through their first six characters."""
    fragments = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "[.\n]")).alias("f")).select("item_id", F.trim("f").alias("f")).where("length(f) >= 6")
    rows = lines(spread(table(spark, sf_dir, "documents")))
    met = T.held_in(fragments, "f", rows, "line", 6).where(F.col("line").contains(F.col("f")))
    scored = met.groupBy("item_id", "doc_id", "pos").agg((1000 + F.least(F.max(F.length("f")), F.lit(200))).alias("score")).where("score >= 1006")
    best = scored.groupBy("item_id").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"), (-F.col("pos")).alias("p"))).alias("b"))
    return best.select("item_id", (-F.col("b.d")).alias("doc_id"), (-F.col("b.p")).cast("long").alias("pos"), F.col("b.score").alias("score"))


@Q.plan("d8_sampled_lines", f"WITH {_LINES}, m AS (SELECT lang, line FROM l JOIN documents USING (doc_id) WHERE contains(line, 'on') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) <= 20) SELECT lang, array_to_string(list_sort(list_distinct(list(line)))[1:5], chr(10)) AS sample FROM m GROUP BY 1")
def sampled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, the first twenty lines with a term, distinct, sorted, of which the first five. The rank is cut before the shuffle."""
    rows = lines(table(spark, sf_dir, "documents")).where(F.col("line").contains("on")).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id", "pos"))).where("n <= 20")
    return first.groupBy("lang").agg(F.array_join(F.slice(F.sort_array(F.collect_set("line")), 1, 5), "\n").alias("sample"))


_D14 = "n AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN p_name || ' [required]' WHEN 2 THEN '()' WHEN 3 THEN 'Chapter' ELSE p_name || ' ' || (p_partkey % 50) END AS name FROM part)"


@Q.plan("d14_clean_audit", f"""WITH {_D14}, k AS (SELECT *, regexp_replace(replace(replace(lower(name), '[required]', ''), ' ', ''), '^[().,;:-]+|[().,;:-]+$', '', 'g') AS key FROM n),
r AS (SELECT *, CASE WHEN trim(name) = '' THEN 'empty' WHEN name IN ('Chapter', 'Part') THEN 'wrapper' WHEN key = '' THEN 'empty_key' WHEN length(key) < 7 THEN 'shell' WHEN row_number() OVER (PARTITION BY key ORDER BY p_partkey) > 1 THEN 'duplicate' ELSE 'kept' END AS reason FROM k)
SELECT reason, count(*) AS n, min(p_partkey) AS first, count(DISTINCT key) AS keys FROM r GROUP BY 1""")
def clean_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why rows are ignored: empty, a wrapper, nothing left of the key, a shell, a repeat of a key; the first row of a key stays."""
    part = table(spark, sf_dir, "part")
    pick = F.col("p_partkey") % 9
    name = F.when(pick == 0, "").when(pick == 1, F.concat("p_name", F.lit(" [required]"))).when(pick == 2, "()").when(pick == 3, "Chapter").otherwise(F.concat_ws(" ", "p_name", (F.col("p_partkey") % 50).cast("string")))
    rows = part.select("p_partkey", name.alias("name")).withColumn("key", T.outline_key(F.col("name")))
    first = rows.groupBy("key").agg(F.min("p_partkey").alias("first"))  # pre-aggregated, so an empty key of many rows makes no hot task
    reason = F.when(F.trim("name") == "", "empty").when(F.col("name").isin("Chapter", "Part"), "wrapper").when(F.col("key") == "", "empty_key").when(F.length("key") < 7, "shell").when(F.col("p_partkey") > F.col("first"), "duplicate").otherwise("kept")
    return rows.join(first, "key").withColumn("reason", reason).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"), F.countDistinct("key").alias("keys"))


#: Cost of a million tokens by role.
RATES = {"assistant": 2.0, "user": 0.8, "system": 0.5}


@Q.plan("d17_usage_cost", """WITH t AS (SELECT role, turn, len(string_split(text, ' ')) AS tokens, role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS again FROM conversations),
g AS (SELECT role, count(*) AS calls, count(*) FILTER (again) AS retries, sum(tokens)::BIGINT AS tokens, (coalesce(sum(tokens) FILTER (turn >= 4), 0) - coalesce(sum(tokens) FILTER (turn < 4), 0))::BIGINT AS delta FROM t GROUP BY 1)
SELECT role, calls, retries, tokens, delta, round(tokens * CASE role WHEN 'assistant' THEN 2.0 WHEN 'user' THEN 0.8 WHEN 'system' THEN 0.5 END / 1e6, 8) AS cost FROM g""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, retries (a role twice in a row), tokens (words), later turns' less earlier ones', and cost by a table of rates."""
    c = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    t = c.select("role", "turn", F.size(F.split("text", " ")).alias("tokens"), (F.lag("role").over(order) == F.col("role")).alias("again"))
    late = F.when(F.col("turn") >= 4, F.col("tokens")).when(F.col("turn") < 4, -F.col("tokens"))
    sums = t.groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.count_if("again").alias("retries"), F.sum("tokens").alias("tokens"), F.coalesce(F.sum(late), F.lit(0)).alias("delta"))
    rates = spark.createDataFrame(list(RATES.items()), "role string, rate double")
    return sums.join(F.broadcast(rates), "role", "left").select("role", "calls", "retries", "tokens", "delta", F.round(F.col("tokens") * F.col("rate") / 1e6, 8).alias("cost"))  # one row per role


@Q.plan("d19_object_merge", """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status, o_orderpriority AS p FROM orders), u AS (SELECT o_custkey, p, min(o_orderkey) AS k FROM o GROUP BY ALL)
SELECT o_custkey, (SELECT arg_min(status, o_orderkey) FROM o WHERE o.o_custkey = c.o_custkey AND status <> '') AS status, (SELECT string_agg(p, '/' ORDER BY k) FROM u WHERE u.o_custkey = c.o_custkey) AS priorities FROM (SELECT DISTINCT o_custkey FROM o) c""")
def object_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads merged in order: a scalar's first value that isn't empty, a list's union in order of first appearance."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("status"), "o_orderpriority")
    scalars = o.groupBy("o_custkey").agg(F.min(F.when(F.col("status") != "", F.struct("o_orderkey", "status"))).alias("s"))
    firsts = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k")).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("k", "o_orderpriority"))).alias("l"))
    return scalars.join(firsts, "o_custkey").select("o_custkey", F.col("s.status").alias("status"), F.array_join(F.transform("l", lambda x: x["o_orderpriority"]), "/").alias("priorities"))


@Q.plan("e7_running_cap", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), l AS (SELECT *, lead(n) OVER (PARTITION BY user_id ORDER BY n) AS stop FROM s WHERE event_type = 'signup'), m AS (SELECT user_id, max(n) AS last FROM s GROUP BY 1),
x AS (SELECT l.user_id, l.n, l.event_id % 3 AS number, sum(s.value) AS size, max((s.event_type = 'purchase')::INT) AS tables FROM l JOIN m USING (user_id) JOIN s ON s.user_id = l.user_id AND s.n > l.n AND s.n < coalesce(stop, last + 1) GROUP BY ALL),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY user_id, number ORDER BY round(least(size, 3200) + 2000 * tables + n, 4) DESC, n) = 1),
c AS (SELECT *, sum(size) OVER (PARTITION BY user_id ORDER BY n) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n) AS k FROM b)
SELECT user_id, n, number FROM c WHERE k = 1 OR round(total, 6) <= 1500""")
def attachment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from a label to the next: per number the best by size, table and place; then in order while they fit in 1500, the first always."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(order).cast("long"))
    label = F.col("event_type") == "signup"
    upto = Window.partitionBy("user_id").orderBy("n")
    s = s.withColumn("start", F.max(F.when(label, F.col("n"))).over(upto)).withColumn("owner", F.max(F.when(label, F.struct("n", "event_id"))).over(upto))
    spans = s.where(~label & F.col("start").isNotNull()).groupBy("user_id", F.col("start").alias("n"), (F.col("owner.event_id") % 3).alias("number")).agg(F.sum("value").alias("size"), F.max(hit(F.col("event_type") == "purchase")).alias("tables"))
    score = F.round(F.least("size", F.lit(3200)) + 2000 * F.col("tables") + F.col("n"), 4)
    best = spans.withColumn("q", F.row_number().over(Window.partitionBy("user_id", "number").orderBy(score.desc(), "n"))).where("q = 1")
    placed = Window.partitionBy("user_id").orderBy("n")
    kept = best.withColumn("total", F.sum("size").over(placed)).withColumn("k", F.row_number().over(placed)).where((F.col("k") == 1) | (F.round("total", 6) <= 1500))
    return kept.select("user_id", "n", "number")


@Q.plan("e8_family_top", """WITH f AS (SELECT p_brand, p_partkey, split_part(p_name, ' ', 2) AS family, p_size % 11 AS score FROM part WHERE p_size % 11 > 0), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY p_brand, family ORDER BY score DESC, p_partkey) = 1)
SELECT p_brand, family, p_partkey, score::INT AS score FROM b QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) <= 3""")
def family_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand's title families (a name's second word) the best candidate above zero, of these the best three."""
    f = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.get(F.split("p_name", " "), F.lit(1)).alias("family"), (F.col("p_size") % 11).cast("int").alias("score")).where("score > 0")
    b = f.groupBy("p_brand", "family").agg(F.max(F.struct("score", (-F.col("p_partkey")).alias("k"))).alias("b")).select("p_brand", "family", (-F.col("b.k")).alias("p_partkey"), "b.score")
    return b.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey"))).where("n <= 3").drop("n")


@Q.plan("e18_run_extract", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), g AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY n) AS g FROM s),
r AS (SELECT *, event_id % 40 AS key, row_number() OVER (PARTITION BY user_id, g ORDER BY n) AS k FROM g WHERE g > 0 AND event_type <> 'signup'), d AS (SELECT *, event_type = 'purchase' OR row_number() OVER (PARTITION BY user_id, g, key ORDER BY k) > 1 AS stops FROM r),
e AS (SELECT user_id, g, coalesce(min(k) FILTER (stops), max(k) + 1) - 1 AS rows, min(n) AS first, count(*) FILTER (event_type = 'click') AS marks FROM d GROUP BY ALL), o AS (SELECT e.user_id, e.g, e.rows, e.first, count(*) FILTER (d.event_type = 'click') AS marks FROM e JOIN d ON d.user_id = e.user_id AND d.g = e.g AND d.k <= e.rows GROUP BY ALL)
SELECT user_id, first, rows FROM o WHERE rows >= 5 OR rows >= 3 AND marks > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rows DESC, first) = 1""")
def run_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's longest run of directory rows: behind a heading, up to a boundary or a repeated key; five rows, or three with a marked one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(order).cast("long")).withColumn("key", F.col("event_id") % 40)
    s = s.withColumn("g", F.sum(hit(F.col("event_type") == "signup")).over(Window.partitionBy("user_id").orderBy("n")))
    r = s.where((F.col("g") > 0) & (F.col("event_type") != "signup"))
    own = Window.partitionBy("user_id", "g").orderBy("n")
    stops = (F.col("event_type") == "purchase") | (F.row_number().over(Window.partitionBy("user_id", "g", "key").orderBy("n")) > 1)
    r = r.withColumn("stopped", F.max(hit(stops)).over(own)).where("stopped = 0")
    # the first row stays in sight of its run by its place, also where the run is empty
    runs = r.groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("first"), F.count_if(F.col("event_type") == "click").alias("marks")).where("rows >= 5 OR rows >= 3 AND marks > 0")
    best = runs.groupBy("user_id").agg(F.max(F.struct("rows", (-F.col("first")).alias("f"))).alias("b"))
    return best.select("user_id", (-F.col("b.f")).alias("first"), "b.rows")


@Q.plan("e22_fact_ordinals", "SELECT event_id, event_type || ':' || row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS fact_id FROM events")
def fact_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts numbered within their group: a few large groups, so places come from range partitions and not from one task a group."""
    placed = positions(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_id"], ["event_type"])
    return placed.select("event_id", F.concat("event_type", F.lit(":"), (F.col("q_pos") + 1).cast("string")).alias("fact_id"))


@Q.plan("f2_multi_key_order", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey) AS place FROM customer")
def multi_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in an order by several keys, nulls last going up and first going down, by range partitions."""
    keys = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").isNull().alias("k1"), "c_mktsegment", F.col("c_acctbal").isNotNull().alias("k2"), (-F.col("c_acctbal")).alias("k3"))
    return positions(keys, ["k1", "c_mktsegment", "k2", "k3", "c_custkey"]).select("c_custkey", (F.col("q_pos") + 1).alias("place"))


@Q.plan("f9_evidence_caps", "SELECT user_id, array_to_string(list_sort(list(event_id))[1:3], ',') AS first3 FROM events GROUP BY user_id")
def evidence_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pieces of evidence per key: cut by rank before they are gathered."""
    first = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("n <= 3")
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("first3"))


#: Query words and what they are widened by.
SYNONYMS = {"bolt": ("screw", "fastener"), "ring": ("washer",), "gear": ("cog", "wheel")}


@Q.plan("h8_expansion", """WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), e AS (SELECT * FROM w UNION SELECT p_partkey, s FROM w JOIN (VALUES ('bolt', 'screw'), ('bolt', 'fastener'), ('ring', 'washer'), ('gear', 'cog'), ('gear', 'wheel')) AS x(k, s) ON w = k),
g AS (SELECT * FROM e WHERE length(w) >= 2 UNION SELECT p_partkey, substr(w, i, n) FROM (SELECT p_partkey, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM e, (VALUES (2), (3), (4)) AS x(n) WHERE length(w) >= n)) SELECT p_partkey, count(*) AS n, array_to_string(list_sort(list(w)), ' ') AS terms FROM g GROUP BY 1""")
def expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's terms: its words, what its words are widened by, and the parts of 2 to 4 letters of both."""
    words = F.split(F.lower("p_name"), " ")
    more = F.flatten(F.array(*[F.when(F.array_contains(words, k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in SYNONYMS.items()]))
    terms = F.filter(T.grams(F.array_join(F.array_union(words, more), " ")), lambda w: F.length(w) >= 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(terms).cast("long").alias("n"), F.array_join(F.sort_array(terms), " ").alias("terms"))


#: Fixed values of notations.
ROMAN = (("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l"))
DIGITS = "〇一二三四五六七八九"


@Q.plan("h18_zero_padded", """SELECT p_partkey, CASE WHEN p_size <= 26 THEN chr(96 + p_size) ELSE chr(96 + (p_size - 1) // 26) || chr(97 + (p_size - 1) % 26) END AS alpha, ['', 'x', 'xx', 'xxx', 'xl', 'l'][p_size // 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][p_size % 10 + 1] AS roman,
CASE WHEN p_size < 10 THEN substr('〇一二三四五六七八九', p_size + 1, 1) ELSE (CASE WHEN p_size < 20 THEN '' ELSE substr('〇一二三四五六七八九', p_size // 10 + 1, 1) END) || '十' || (CASE WHEN p_size % 10 = 0 THEN '' ELSE substr('〇一二三四五六七八九', p_size % 10 + 1, 1) END) END AS han, printf('%04d', p_size) AS padded FROM part""")
def notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers up to 59 as letters, Roman and Han numerals, and padded."""
    n = F.col("p_size")
    tens, ones = F.floor(n / 10).cast("int"), n % 10
    of = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
    alpha = F.when(n <= 26, F.char(96 + n)).otherwise(F.concat(F.char(96 + F.floor((n - 1) / 26)), F.char(97 + (n - 1) % 26)))
    han = F.when(n < 10, of(DIGITS, n)).otherwise(F.concat(F.when(tens > 1, of(DIGITS, tens)).otherwise(""), F.lit("十"), F.when(ones > 0, of(DIGITS, ones)).otherwise("")))
    return table(spark, sf_dir, "part").select("p_partkey", alpha.alias("alpha"), F.concat(of(ROMAN[1], tens), of(ROMAN[0], ones)).alias("roman"), han.alias("han"), F.lpad(n.cast("string"), 4, "0").alias("padded"))


@Q.plan("h15_placeholder", "SELECT p_partkey FROM part WHERE p_partkey % 6 IN (0, 1, 2, 3)")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are empty or marked as unfinished, of rows made so by their key: the counterpart knows which."""
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "  ").when(k == 2, F.concat(F.lit("TBD "), "p_name")).when(k == 3, F.concat("p_name", F.lit(" (to be filled in)"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").where(T.is_placeholder(name)).select("p_partkey")


@Q.plan("h21_reference", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE (o_orderkey % 90)::INT END AS number FROM orders")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachment numbers out of references in several spellings; the last spelling has none."""
    k, n = F.col("o_orderkey") % 4, (F.col("o_orderkey") % 90).cast("string")
    said = F.when(k == 0, F.concat(F.lit("see Annex 0"), n)).when(k == 1, F.concat(F.lit("附件"), n, F.lit("：格式"))).when(k == 2, F.concat(F.lit("as in Appendix "), n, F.lit("."))).otherwise(F.concat(F.lit("page "), n))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.reference_number(said).alias("number"))


@Q.plan("i7_timeline_score", f"""WITH {_LINES}, t AS (SELECT doc_id, text, lower(text) AS x, lower(split_part(text, chr(10), 1)) AS title FROM documents),
s AS (SELECT doc_id, 120 * regexp_matches(x, 'valid|ement')::INT + 80 * contains(x, 'tion')::INT + 80 * contains(x, 'open')::INT + 110 * regexp_matches(x, '[0-9]{{1,2}}[:/.][0-9]{{2}}')::INT + 25 * regexp_matches(title, 'the|die|el ')::INT - 30 * (length(text) > 3000)::INT AS score FROM t) SELECT doc_id, score::INT AS score FROM s WHERE score >= 100""")
def timeline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections on dates: validity 120, deadline 80, opening 80, a time 110, title 25, long texts -30; those from 100 on."""
    x, title = F.lower("text"), F.lower(F.substring_index("text", "\n", 1))
    either = lambda c, *ws: hit(F.exists(F.array(*map(F.lit, ws)), lambda w: c.contains(w)))
    score = 120 * either(x, "valid", "ement") + 80 * either(x, "tion") + 80 * either(x, "open") + 110 * hit(x.rlike("[0-9]{1,2}[:/.][0-9]{2}")) + 25 * either(title, "the", "die", "el ") - 30 * hit(F.length("text") > 3000)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score")).where("score >= 100")


@Q.plan("j9_category_match", """WITH q AS (SELECT unnest(['ECONOMY', 'SMALL', 'PROMO', 'big']) AS q), k AS (SELECT DISTINCT p_type FROM part), s AS (SELECT p_type, q, CASE WHEN p_type = q THEN 100 WHEN lower(p_type) = lower(q) THEN 95 WHEN starts_with(p_type, q) THEN 80 WHEN contains(p_type, q) THEN 75 WHEN starts_with(q, p_type) THEN 70 WHEN contains(q, p_type) THEN 60 WHEN q = 'big' AND p_type = 'LARGE' THEN 50 ELSE 0 END AS score FROM k, q)
SELECT p_type, q AS category, score::INT AS score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY score DESC, q) = 1""")
def category_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kind's best category: equal 100 or 95, contained 80 to 60, an alias below; the few categories are literals of the expression."""
    kind = F.col("p_type")

    def score(q: str) -> Column:
        c = F.lit(q)
        alias = F.lit(q == "big") & (kind == "LARGE")
        return F.when(kind == c, 100).when(F.lower(kind) == F.lower(c), 95).when(kind.startswith(q), 80).when(kind.contains(q), 75).when(c.startswith(kind), 70).when(c.contains(kind), 60).when(alias, 50).otherwise(0)

    rated = F.array(*[F.struct((-score(q)).alias("s"), F.lit(q).alias("q")) for q in ("ECONOMY", "SMALL", "PROMO", "big")])
    best = table(spark, sf_dir, "part").select("p_type").distinct().select("p_type", F.array_min(rated).alias("b"))
    return best.select("p_type", F.col("b.q").alias("category"), (-F.col("b.s")).alias("score")).where("score > 0")


@Q.plan("l2_adjacency", "SELECT p_partkey, (SELECT min(x.p_partkey) FROM part x WHERE x.p_brand = p.p_brand AND x.p_size % 5 = 0) AS parent FROM part p WHERE p_size % 5 <> 0 AND p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) FILTER (p_size % 5 = 0) >= 2)")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows below the first group row of their table, for tables with two groups at least: one pre-aggregated row per table is joined back."""
    part = table(spark, sf_dir, "part")
    heads = part.where("p_size % 5 = 0").groupBy("p_brand").agg(F.min("p_partkey").alias("parent"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return part.where("p_size % 5 <> 0").join(heads, "p_brand").select("p_partkey", "parent")


@Q.plan("m1_section_locate", f"""WITH {_LINES}, r AS (SELECT * FROM (VALUES (1, 'tion'), (2, 'ing'), (3, 'que'), (4, 'der'), (5, 'worthless'), (6, 'ent'), (7, 'ción')) AS r(rule, word)),
h AS (SELECT doc_id, rule, min(pos) AS pos FROM l JOIN r ON contains(lower(line), word) GROUP BY ALL), t AS (SELECT doc_id, 0 AS rule, min(pos) AS pos FROM l WHERE contains(line, '|') GROUP BY 1),
u AS (SELECT doc_id, pos, min(rule) AS rule FROM (SELECT * FROM h UNION ALL SELECT * FROM t) GROUP BY ALL) SELECT doc_id, pos, rule FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rule, pos) <= 5""")
def section_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located lines: a table first, then the first hit of each keyword rule; a line counts for its first rule, five lines at most."""
    words = ("tion", "ing", "que", "der", "worthless", "ent", "ción")
    low = F.lower("line")
    rules = F.filter(F.array(F.when(F.col("line").contains("|"), F.lit(0)), *[F.when(low.contains(w), F.lit(k)) for k, w in enumerate(words, 1)]), lambda r: r.isNotNull())
    first = lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.explode(rules).alias("rule")).groupBy("doc_id", "rule").agg(F.min("pos").cast("long").alias("pos"))
    once = first.groupBy("doc_id", "pos").agg(F.min("rule").alias("rule"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("rule", "pos"))).where("n <= 5").drop("n")


@Q.plan("m3_candidates", """WITH t AS (SELECT doc_id, source, lang, n_chars, contains(lower(text), 'tion') AS tagged, contains(text, '|') AS protected FROM documents), k AS (SELECT * FROM t WHERE tagged OR protected OR doc_id % 10 = 0),
m AS (SELECT source, lang, min(n_chars) AS least, count(*) FILTER (n_chars <= 2000) AS small FROM k GROUP BY ALL) SELECT doc_id, CASE WHEN protected THEN 'protected' WHEN n_chars = least THEN 'shallowest' ELSE 'tagged' END AS why FROM k JOIN m USING (source, lang) WHERE protected OR n_chars <= 2000 OR small = 0""")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension's candidates: head rows, tagged ones and protected lists; umbrellas go unless nothing else is in their group. One row per group is joined back."""
    t = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.lower("text").contains("tion").alias("tagged"), F.col("text").contains("|").alias("protected"))
    k = t.where("tagged OR protected OR doc_id % 10 = 0")  # every tenth is the fixture's head row
    m = k.groupBy("source", "lang").agg(F.min("n_chars").alias("least"), F.count_if(F.col("n_chars") <= 2000).alias("small"))
    why = F.when(F.col("protected"), "protected").when(F.col("n_chars") == F.col("least"), "shallowest").otherwise("tagged")
    return k.join(m, ["source", "lang"]).where("protected OR n_chars <= 2000 OR small = 0").select("doc_id", why.alias("why"))


@Q.plan("m8_material_mapping", """WITH o AS (SELECT o_orderkey, min(l_suppkey) AS sup, min(l_partkey) AS prt FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN s.s_acctbal > 7000 THEN 'certificate:' || s_suppkey WHEN p.p_type = 'PROMO' THEN 'template:' || p_partkey WHEN o_totalprice > 200000 THEN 'supporting:' || o_custkey ELSE 'manual' END AS material FROM o JOIN orders USING (o_orderkey) LEFT JOIN supplier s ON s_suppkey = sup LEFT JOIN part p ON p_partkey = prt""")
def material_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a node's material comes from: a certificate, else a template, else a supporting document, else by hand: a cascade over left joins."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("s_suppkey"), F.min("l_partkey").alias("p_partkey"))
    cert = table(spark, sf_dir, "supplier").where("s_acctbal > 7000").select("s_suppkey", F.concat(F.lit("certificate:"), "s_suppkey").alias("a"))
    form = table(spark, sf_dir, "part").where("p_type = 'PROMO'").select("p_partkey", F.concat(F.lit("template:"), "p_partkey").alias("b"))
    rows = orders.join(line, "o_orderkey", "left").join(cert, "s_suppkey", "left").join(form, "p_partkey", "left")
    return rows.select("o_orderkey", F.coalesce("a", "b", F.when(F.col("o_totalprice") > 200000, F.concat(F.lit("supporting:"), "o_custkey")), F.lit("manual")).alias("material"))


#: Rules in order: kinds and words that each takes, its category and whether it is fatal.
RULES = ((1, "", "worthless", "LANGUAGE", True), (2, "missing_material", "", "MATERIAL", True), (3, "incomplete_content,shape", "", "CONTENT", False), (4, "structured,backfill,placeholder_residue", "", "STRUCTURE", False))


@Q.plan("m12_compliance", """WITH i AS (SELECT doc_id, 'missing_material' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'incomplete_content' FROM documents WHERE n_chars < 400 UNION ALL SELECT doc_id, 'shape' FROM documents WHERE NOT contains(text, chr(10))
UNION ALL SELECT doc_id, 'placeholder_residue' FROM documents WHERE regexp_matches(lower(text), 'todo|tbd|xxx|lorem|\\[insert|to be filled|placeholder|待补充|此处填写') OR trim(text) = '' UNION ALL SELECT doc_id, 'backfill' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'structured' FROM labels WHERE toxic = 1),
r AS (SELECT * FROM (VALUES (1, '', 'worthless', 'LANGUAGE', true), (2, 'missing_material', '', 'MATERIAL', true), (3, 'incomplete_content,shape', '', 'CONTENT', false), (4, 'structured,backfill,placeholder_residue', '', 'STRUCTURE', false)) AS r(ord, kinds, word, category, fatal))
SELECT i.doc_id, i.kind, r.category, r.fatal FROM i LEFT JOIN documents d USING (doc_id) LEFT JOIN r ON list_contains(string_split(kinds, ','), kind) OR (word <> '' AND contains(lower(coalesce(d.text, '')), word)) QUALIFY row_number() OVER (PARTITION BY i.doc_id, i.kind ORDER BY r.ord) = 1""")
def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of six checks, each with the category of the first rule, in their order, that takes its kind or whose word the text has."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    none = F.array().cast("array<string>")
    when = lambda c, kind: F.when(c, F.array(F.lit(kind))).otherwise(none)
    rows = docs.select("doc_id", "text", "n_chars").join(labels.select("doc_id", "quality", "toxic", F.lit(True).alias("known")), "doc_id", "full_outer")
    real = F.col("n_chars").isNotNull()
    kinds = F.flatten(F.array(when(F.col("known").isNull(), "missing_material"), when(real & (F.col("n_chars") < 400), "incomplete_content"), when(real & ~F.col("text").contains("\n"), "shape"), when(real & T.is_placeholder(F.col("text")), "placeholder_residue"), when(F.col("quality") == 0, "backfill"), when(F.col("toxic") == 1, "structured")))
    issues = rows.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"), F.explode(kinds).alias("kind"))
    rules = F.array(*[F.struct(F.split(F.lit(k), ",").alias("kinds"), F.lit(w).alias("word"), F.lit(c).alias("category"), F.lit(f).alias("fatal")) for _, k, w, c, f in RULES])
    rule = F.get(F.filter(rules, lambda r: F.array_contains(r["kinds"], F.col("kind")) | ((r["word"] != "") & F.col("low").contains(r["word"]))), F.lit(0))
    return issues.select("doc_id", "kind", rule["category"].alias("category"), rule["fatal"].alias("fatal"))


@Q.plan("j2_dense_cosine", "SELECT query, vec_id, n::INT AS n, score FROM (SELECT q.vec_id AS query, d.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 5) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 5) DESC, d.vec_id) AS n FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id) WHERE n <= 8")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as a query against all vectors, exact: the index only lets tasks skip cells that are out of reach."""
    rows = _vectors(spark, sf_dir)
    found = VectorIndex.build(rows).nearest(rows.where("id % 100 = 0"), 8)
    return found.select("query", F.col("id").alias("vec_id"), "n", "score")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@Q.plan("j2_probed_topk")
def probed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As j2_dense_cosine, by the cells nearest to each query alone, as many as a sample's rows need for 0.95 of their neighbours."""
    rows = _vectors(spark, sf_dir)
    index = VectorIndex.build(rows)
    found = index.nearest(rows.where("id % 100 = 0"), 8, probes=index.probes_for(8))
    return found.select("query", F.col("id").alias("vec_id"), "n", "score")
