"""Outlines, assignments, evidence and citations: folds over a document's blocks, tree roll-ups and keyed winners.

Fixtures: a user's events in order are a document's blocks (signup, view and click head levels 1 to 3, others are body);
region.nation.customer is a numbered chapter tree; lineitem assigns parts to orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import folds, merging
from docquarry.plans.query import Catalog, table
from docquarry.runtime import spread
from docquarry.sources.readers import lines

Q = Catalog()
LEVELS = {"signup": 1, "view": 2, "click": 3}
_LEVEL = "CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END"
_S = f"s AS (SELECT *, {_LEVEL} AS lv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their place n in the user's order (from 1) and level lv."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    level = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).otherwise(4)
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(order)).withColumn("lv", level)


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chapter_id (r, r.n, r.n.c), name, level."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("chapter_id"), F.col("r_name").alias("name"), F.lit(1).alias("level"))
    n = table(spark, sf_dir, "nation").select(F.concat_ws(".", "n_regionkey", "n_nationkey"), "n_name", F.lit(2))
    place = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat_ws(".", "n_regionkey", "n_nationkey").alias("up"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(place), "c_nationkey").select(F.concat_ws(".", "up", "c_custkey"), "c_name", F.lit(3))  # nations are a fixed table
    return r.union(n).union(c)


_CH = "ch AS (SELECT r_regionkey::VARCHAR AS chapter_id, r_name AS name, 1 AS level FROM region UNION ALL SELECT n_regionkey || '.' || n_nationkey, n_name, 2 FROM nation UNION ALL SELECT n_regionkey || '.' || n_nationkey || '.' || c_custkey, c_name, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@Q.plan("c19_parent_fallback", f"""WITH RECURSIVE {_S}, w AS (SELECT *, event_type || n AS name, CASE event_id % 7 WHEN 0 THEN 'view' || (n + 1) WHEN 1 THEN 'signup' || (n - 2) WHEN 2 THEN event_type || n END AS wanted FROM s),
x AS (SELECT w.user_id, w.n, w.lv, p.n AS at FROM w LEFT JOIN w AS p ON p.user_id = w.user_id AND p.name = w.wanted AND p.n <> w.n),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, [0, 0, 0, 0]::BIGINT[] AS st, NULL::BIGINT AS parent, 0 AS level FROM x UNION ALL
  SELECT user_id, n, list_transform([1, 2, 3, 4], lambda i: CASE WHEN i = lvl THEN n WHEN i > lvl THEN 0 ELSE st[i] END), p, lvl FROM (SELECT *, CASE WHEN p IS NULL THEN 1 ELSE lv END AS lvl FROM (
    SELECT x.user_id, x.n, x.lv, f.st, coalesce(x.at, CASE WHEN x.lv >= 4 AND f.st[3] > 0 THEN f.st[3] WHEN x.lv >= 3 AND f.st[2] > 0 THEN f.st[2] WHEN x.lv >= 2 AND f.st[1] > 0 THEN f.st[1] END) AS p
    FROM f JOIN x ON x.user_id = f.user_id AND x.n = f.n + 1)))
SELECT user_id, n, parent, level FROM f WHERE n > 0""")
def parent_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline rows to parents: the one named (anywhere, not itself), else the nearest lower level on the stack, else a root, whose level becomes 1."""
    rows = stream(spark, sf_dir).withColumn("name", F.concat("event_type", "n"))
    wanted = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("view"), F.col("n") + 1)).when(F.col("event_id") % 7 == 1, F.concat(F.lit("signup"), F.col("n") - 2)).when(F.col("event_id") % 7 == 2, F.col("name"))
    rows = rows.select("user_id", "n", "lv", "name", wanted.alias("parent_name"))
    return folds.place_in_outline(rows, "user_id", "n", "lv", "name", "parent_name").select("user_id", F.col("n").cast("long"), F.col("parent").cast("long"), "level")


_E15 = "t AS (SELECT *, CASE event_type WHEN 'signup' THEN (n // 9 + 1) || '. Title' WHEN 'purchase' THEN 'Title' WHEN 'click' THEN (n // 9 + 1) || '.' || (event_id % 3 + 1) || '.' || (event_id % 2 + 1) || ' Title' ELSE (n // 9 + 1) || '.' || (event_id % 3 + 1) || ' Title' END AS text, event_id % 5 AS level FROM s)"


@Q.plan("e15_number_levels", f"""WITH RECURSIVE {_S}, {_E15}, x AS (SELECT *, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, '.')) END AS d, regexp_replace(p, '[.]?[0-9]+$', '') AS up FROM (SELECT user_id, n, level, regexp_extract(text, '^([0-9]+(?:[.][0-9]+)*)[. ]', 1) AS p FROM t)),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, ['', '', '', '', '', ''] AS st, 0::BIGINT AS level FROM x UNION ALL
  SELECT user_id, n, CASE WHEN ok THEN list_transform([1, 2, 3, 4, 5, 6], lambda i: CASE WHEN i = d THEN p WHEN i > d THEN '' ELSE st[i] END) ELSE st END, CASE WHEN NOT ok THEN level WHEN d = 1 THEN 2 ELSE least(d, 4) END FROM (
    SELECT x.*, f.st, x.level > 0 AND x.d > 0 AND (x.d = 1 OR f.st[x.d] = '' OR f.st[x.d - 1] <> '' OR regexp_replace(f.st[x.d], '[.]?[0-9]+$', '') = x.up) AS ok FROM f JOIN x ON x.user_id = f.user_id AND x.n = f.n + 1))
SELECT user_id, n, level FROM f WHERE n > 0""")
def number_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings take the level of their number (1: 2, deeper: its depth, 4 at most) where it carries on from the numbers before."""
    n, e = F.floor(F.col("n") / 9) + 1, F.col("event_id")
    text = F.when(F.col("event_type") == "signup", F.concat(n, F.lit(". Title"))).when(F.col("event_type") == "purchase", "Title")
    text = text.when(F.col("event_type") == "click", F.concat(F.concat_ws(".", n, e % 3 + 1, e % 2 + 1), F.lit(" Title"))).otherwise(F.concat(F.concat_ws(".", n, e % 3 + 1), F.lit(" Title")))
    rows = stream(spark, sf_dir).select("user_id", "n", text.alias("text"), (e % 5).cast("int").alias("level"))
    return folds.smooth_levels(rows, "user_id", "n", "text", "level").select("user_id", F.col("n").cast("long"), F.col("level").cast("long"))


@Q.plan("e21_empty_titles", f"""WITH {_S}, g AS (SELECT *, sum((event_type <> 'view')::INT) OVER (PARTITION BY user_id ORDER BY n) AS g FROM s),
h AS (SELECT user_id, g, arg_min(event_type, n) AS head, min(n) AS seed, count(*) FILTER (event_type = 'view') AS views, arg_min(event_id, n) AS head_id FROM g GROUP BY ALL),
l AS (SELECT *, lead(head) OVER o AS stop, lead(head_id) OVER o AS stop_id FROM h WINDOW o AS (PARTITION BY user_id ORDER BY g)),
i AS (SELECT l.user_id, l.seed, g.n, 'item ' || (g.event_id % 4) AS name FROM l JOIN g USING (user_id, g) WHERE l.head = 'signup' AND l.views >= 3 AND g.event_type = 'view'
  UNION ALL SELECT user_id, seed, 1000000000, 'terms ' || (stop_id % 3) FROM l WHERE head = 'signup' AND views >= 3 AND stop = 'purchase'),
d AS (SELECT user_id, seed, name, min(n) AS n FROM i GROUP BY ALL)
SELECT user_id, seed, string_agg(name, chr(10) ORDER BY n) AS content FROM d GROUP BY ALL""")
def empty_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three or more empty titles (views) right behind a list's intro (signup) are its rows; those of a closing purchase follow. Equal names count once."""
    rows = stream(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy("n")
    rows = rows.withColumn("g", F.sum((F.col("event_type") != "view").cast("int")).over(order))
    item = F.when(F.col("event_type") == "view", F.struct("n", F.concat(F.lit("item "), F.col("event_id") % 4).alias("name")))
    groups = rows.groupBy("user_id", "g").agg(F.min(F.struct("n", "event_type", "event_id")).alias("head"), F.array_sort(F.collect_list(item)).alias("items"))
    after = Window.partitionBy("user_id").orderBy("g")
    groups = groups.withColumn("stop", F.lead("head").over(after)).where((F.col("head.event_type") == "signup") & (F.size("items") >= 3))
    terms = F.when(F.col("stop.event_type") == "purchase", F.array(F.concat(F.lit("terms "), F.col("stop.event_id") % 3))).otherwise(F.array().cast("array<string>"))
    names = F.array_distinct(F.concat(F.transform("items", lambda x: x["name"]), terms))
    return groups.select("user_id", F.col("head.n").cast("long").alias("seed"), F.array_join(names, "\n").alias("content"))


@Q.plan("e9_single_owner", """WITH a AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL), q AS (SELECT l_orderkey, lower(arg_min(p_name, (l_linenumber, p_name))) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
s AS (SELECT a.*, 0.55 * len(list_intersect(list_distinct(string_split(q, ' ')), string_split(lower(p_name), ' '))) / len(list_distinct(string_split(q, ' '))) + 0.25 * (contains(q, lower(p_name)) OR contains(lower(p_name), q))::INT AS score FROM a JOIN q USING (l_orderkey) JOIN part ON p_partkey = l_partkey),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY round(score, 6) DESC, l_orderkey) = 1)
SELECT l_orderkey, l_partkey, 'part' AS source FROM k UNION ALL SELECT DISTINCT l_orderkey, NULL, 'manual' FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM k)""")
def single_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part that several orders are assigned stays with the order whose first part's name it fits best; orders left empty get a manual row."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("p"))
    rows = line.select("l_orderkey", "l_partkey", "l_linenumber").join(part, "l_partkey")
    asked = rows.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "p"))["p"].alias("q"))
    words, own = F.array_distinct(F.split("q", " ")), F.split("p", " ")
    score = 0.55 * F.size(F.array_intersect(words, own)) / F.greatest(F.size(words), F.lit(1)) + 0.25 * (F.col("q").contains(F.col("p")) | F.col("p").contains(F.col("q"))).cast("int")
    scored = rows.select("l_orderkey", "l_partkey", "p").distinct().join(asked, "l_orderkey").select("l_orderkey", "l_partkey", F.round(score, 6).alias("score"))
    return merging.single_owner(scored, "l_orderkey", "l_partkey", "score").select("l_orderkey", "l_partkey", F.when(F.col("l_partkey").isNull(), "manual").otherwise("part").alias("source"))


HAN = str.maketrans("abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地人和")


@Q.plan("h7_han_grams", f"""WITH t AS (SELECT p_partkey, regexp_extract_all(translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz', '{''.join(map(chr, HAN.values()))}'), '[一-鿿]+') AS r FROM part),
g AS (SELECT p_partkey, w AS g FROM (SELECT p_partkey, unnest(r) AS w FROM t) UNION SELECT p_partkey, substr(w, i, k) FROM (SELECT p_partkey, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM (SELECT p_partkey, unnest(r) AS w FROM t), (VALUES (2), (3), (4)) AS x(k) WHERE length(w) >= k))
SELECT p_partkey, count(*) AS n, array_to_string(list_sort(list(g)), ' ') AS grams FROM g GROUP BY 1""")
def han_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of Han characters and their parts of 2 to 4."""
    text = F.translate(F.lower("p_name"), *("".join(map(chr, x)) for x in (HAN.keys(), HAN.values())))
    grams = T.han_grams(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(grams).cast("long").alias("n"), F.array_join(F.sort_array(grams), " ").alias("grams"))


@Q.plan("m15_source_answers", """WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_-]+'), lambda w: length(w) >= 6))) AS term FROM benchmark),
s AS (SELECT doc_id, i - 1 AS pos, trim(regexp_replace(l[i], '[ \\t\\r\\n]+', ' ', 'g')) AS x, lower(regexp_replace(l[1], '[ \\t\\r\\n]+', '', 'g')) AS title, lower(regexp_replace(l[1] || ' ' || l[i], '[ \\t\\r\\n]+', '', 'g')) AS hay FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE length(trim(regexp_replace(l[i], '[ \\t\\r\\n]+', ' ', 'g'))) >= 8),
r AS (SELECT item_id, doc_id, pos, x, sum(2 * least((length(hay) - length(replace(hay, term, ''))) // length(term), 4) + 3 * contains(title, term)::INT) AS score FROM q JOIN s ON contains(hay, term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, pos) AS n FROM r QUALIFY n <= 8)
SELECT item_id, string_agg('S' || n || ':' || doc_id || ':' || (pos // 5 + 1) || ':' || score::BIGINT, ' ' ORDER BY n) AS citations, string_agg('[S' || n || '] ' || left(x, 320), chr(10) ORDER BY n) FILTER (n <= 3) AS answer FROM k GROUP BY 1""")
def source_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered by extracts: lines ranked by their terms (each counts up to four times, more in the document's title), the best eight
    cited with page and score, the first three quoted. Terms meet lines through their first six characters."""
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_-]+"), F.lit(0)), lambda w: F.length(w) >= 6))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(terms).alias("term"))
    wanted = asked.select("term", F.left("term", F.lit(6)).alias("gram")).distinct()
    every = lines(spread(table(spark, sf_dir, "documents")))
    squeeze = lambda c: F.lower(F.regexp_replace(c, "[ \t\r\n]+", ""))
    first = every.where("pos = 0").select("doc_id", squeeze("line").alias("title"))
    said = F.trim(F.regexp_replace("line", "[ \t\r\n]+", " "))
    rows = every.select("doc_id", "pos", said.alias("x"), squeeze("line").alias("own")).where("length(x) >= 8")
    # A gram travels with its line's place only; titles give theirs once a document, and a gram that spans title and line lies in ten characters.
    parts = lambda c: F.explode(F.array_distinct(T.parts_of(c, 6))).alias("gram")
    lined = rows.select("doc_id", "pos", parts(F.col("own"))).join(wanted, "gram").select("doc_id", "pos", "term")
    edges = rows.join(first, "doc_id").select("doc_id", "pos", parts(F.concat(F.right("title", F.lit(5)), F.left("own", F.lit(5))))).join(wanted, "gram").select("doc_id", "pos", "term")
    titled = first.select("doc_id", parts(F.col("title"))).join(wanted, "gram").select("doc_id", "term").distinct().join(rows.select("doc_id", "pos"), "doc_id").select("doc_id", "pos", "term")
    met = lined.unionByName(edges).unionByName(titled).groupBy("doc_id", "pos").agg(F.collect_set("term").alias("terms"))
    # Each line meets its possible terms in one row, which counts them; only places, terms and points go on to the items.
    hay = F.concat("title", "own")
    times = lambda h, t: F.floor((F.length(h) - F.length(F.replace(h, t))) / F.length(t))
    points = F.transform(F.array(hay), lambda h: F.transform(F.filter("terms", lambda t: h.contains(t)), lambda t: F.struct(t.alias("term"), (2 * F.least(times(h, t), F.lit(4)) + 3 * F.col("title").contains(t).cast("int")).alias("n"))))[0]
    counted = rows.join(met, ["doc_id", "pos"]).join(first, "doc_id").select("doc_id", "pos", F.explode(points).alias("p")).select("doc_id", "pos", "p.term", "p.n")
    scored = counted.join(asked, "term").groupBy("item_id", "doc_id", "pos").agg(F.sum("n").alias("score"))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "pos"))).where("n <= 8")
    cited = F.concat(F.lit("S"), "n", F.lit(":"), "doc_id", F.lit(":"), F.expr("pos div 5 + 1"), F.lit(":"), "score")
    quoted = best.join(rows.select("doc_id", "pos", "x"), ["doc_id", "pos"])
    listed = quoted.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("n", cited.alias("c"), F.concat(F.lit("[S"), "n", F.lit("] "), F.left("x", F.lit(320))).alias("a")))).alias("l"))
    return listed.select("item_id", F.array_join(F.transform("l", lambda c: c["c"]), " ").alias("citations"), F.array_join(F.transform(F.slice("l", 1, 3), lambda c: c["a"]), "\n").alias("answer"))


@Q.plan("a3_fragment_merge", f"""WITH {_S}, t AS (SELECT user_id, event_type AS header, n, n // 3 AS page, event_id FROM s WHERE event_type IN ('view', 'click')), b AS (SELECT *, CASE WHEN page - lag(page) OVER (PARTITION BY user_id, header ORDER BY n) <= 1 THEN 0 ELSE 1 END AS brk FROM t),
i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, header ORDER BY n) AS island FROM b)
SELECT user_id, header, min(n) AS pos, min(page) AS page, max(page) AS page_end, string_agg(event_id::VARCHAR, ' ' ORDER BY n) AS body FROM i GROUP BY user_id, header, island""")
def fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables continued over pages: a fragment goes on from the last table of its header, past others, if that ends on this page or the one before."""
    t = stream(spark, sf_dir).where("event_type IN ('view', 'click')").select("user_id", F.col("event_type").alias("header"), F.col("n").cast("long").alias("n"), F.expr("n div 3").alias("page"), "event_id")
    order = Window.partitionBy("user_id", "header").orderBy("n")
    t = t.withColumn("brk", F.coalesce((F.lag("page").over(order) < F.col("page") - 1).cast("int"), F.lit(1))).withColumn("island", F.sum("brk").over(order))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda x: x["event_id"].cast("string")), " ")
    return t.groupBy("user_id", "header", "island").agg(F.min("n").alias("pos"), F.min("page").alias("page"), F.max("page").alias("page_end"), body.alias("body")).drop("island")


@Q.plan("a4_bookmark_parent", """WITH c AS (SELECT n_regionkey, n_nationkey, n_name, c_custkey, replace(c_name, ' ', '') AS key FROM nation JOIN customer ON c_nationkey = n_nationkey),
p AS (SELECT n_regionkey, n_nationkey, 10 * count(*) + CASE WHEN n_name LIKE '%1%' THEN 20 ELSE 0 END AS score FROM c GROUP BY n_regionkey, n_nationkey, n_name HAVING count(*) >= 3),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY score DESC, n_nationkey) = 1), r AS (SELECT n_regionkey, n_nationkey, score, key, min(c_custkey) AS first FROM b JOIN c USING (n_regionkey, n_nationkey) GROUP BY ALL)
SELECT * FROM r QUALIFY count(*) OVER (PARTITION BY n_regionkey) >= 4""")
def bookmark_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bookmark whose children are promoted, per file (region): three children at least, ten points each, twenty for a format title; four distinct rows at least, else none."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    children = customer.select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", F.replace("c_name", F.lit(" ")).alias("key"))
    counts = children.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    scored = nation.join(counts, "n_nationkey").withColumn("score", 10 * F.col("n") + F.when(F.col("n_name").contains("1"), 20).otherwise(0))
    best = scored.groupBy("n_regionkey").agg(F.max(F.struct("score", (-F.col("n_nationkey")).alias("k"))).alias("b")).select("n_regionkey", (-F.col("b.k")).alias("n_nationkey"), "b.score")
    rows = children.join(best, "n_nationkey").groupBy("n_regionkey", "n_nationkey", "score", "key").agg(F.min("c_custkey").alias("first"))
    enough = rows.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("m")).where("m >= 4").select("n_regionkey")
    return rows.join(enough, "n_regionkey", "left_semi").select("n_regionkey", "n_nationkey", "score", "key", "first")


@Q.plan("c16_prefix_children", f"WITH {_CH}, r AS (SELECT unnest(['1', '2.8', '0.5']) AS root) SELECT root, chapter_id, regexp_replace(chapter_id, '[.][^.]*$', '') AS parent FROM r JOIN ch ON starts_with(chapter_id, root || '.')")
def prefix_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of selected chapters by their numbers: an equi-join on each number's own prefixes."""
    roots = spark.createDataFrame([("1",), ("2.8",), ("0.5",)], "root string")
    rows = chapters(spark, sf_dir).withColumn("parts", F.split("chapter_id", "[.]"))
    up = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.array_join(F.slice("parts", 1, k), "."))
    below = rows.where("size(parts) > 1").select("chapter_id", F.array_join(F.slice("parts", 1, F.size("parts") - 1), ".").alias("parent"), F.explode(up).alias("root"))
    return below.join(roots, "root").select("root", "chapter_id", "parent")


@Q.plan("s5_soft_delete", f"WITH {_CH}, r AS (SELECT unnest(['1', '2.8', '0.5']) AS root) SELECT chapter_id, NOT EXISTS (SELECT 1 FROM r WHERE chapter_id = root OR starts_with(chapter_id, root || '.')) AS is_current FROM ch")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and all below them are marked as no longer current."""
    every = chapters(spark, sf_dir)
    gone = prefix_children(spark, sf_dir).select("chapter_id").union(spark.createDataFrame([("1",), ("2.8",), ("0.5",)], "chapter_id string")).distinct().withColumn("gone", F.lit(True))
    return every.join(gone, "chapter_id", "left").select("chapter_id", F.col("gone").isNull().alias("is_current"))


@Q.plan("l3_append_child", f"""WITH {_CH}, n AS (SELECT regexp_replace(chapter_id, '[.][^.]*$', '') AS parent, max(regexp_extract(chapter_id, '([0-9]+)$', 1)::BIGINT) AS last FROM ch WHERE level > 1 GROUP BY 1), a AS (SELECT n_regionkey::VARCHAR AS parent, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
d AS (SELECT parent, s_name, min(s_suppkey) AS k FROM a WHERE s_name NOT IN (SELECT name FROM ch) GROUP BY ALL)
SELECT d.parent || '.' || (coalesce(last, 0) + row_number() OVER (PARTITION BY d.parent ORDER BY k)) AS chapter_id, s_name AS name FROM d LEFT JOIN n ON n.parent = d.parent""")
def append_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers appended below their region's chapter: numbers go on from the largest one; names that the tree has are skipped."""
    tree = chapters(spark, sf_dir)
    last = tree.where("level > 1").groupBy(F.regexp_replace("chapter_id", "[.][^.]*$", "").alias("parent")).agg(F.max(F.substring_index("chapter_id", ".", -1).cast("long")).alias("last"))
    new = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are a fixed table
    new = new.groupBy(F.col("n_regionkey").cast("string").alias("parent"), F.col("s_name").alias("name")).agg(F.min("s_suppkey").alias("k"))
    return folds.appended(new.join(tree.select("name"), "name", "left_anti"), last, "parent", "k", "last").select("chapter_id", "name")


@Q.plan("l6_move_validation", f"""WITH {_CH}, m AS (SELECT chapter_id AS node, CASE level WHEN 1 THEN chapter_id || '.' || (chapter_id::INT) WHEN 2 THEN '3' ELSE (CASE WHEN right(chapter_id, 1) < '5' THEN regexp_replace(chapter_id, '[.][^.]*$', '') ELSE chapter_id END) END AS target FROM ch),
h AS (SELECT a.chapter_id AS node, max(b.level - a.level) AS height FROM ch a JOIN ch b ON b.chapter_id = a.chapter_id OR starts_with(b.chapter_id, a.chapter_id || '.') GROUP BY 1)
SELECT m.node, m.target, CASE WHEN m.node = m.target THEN 'self' WHEN starts_with(m.target, m.node || '.') THEN 'descendant' WHEN t.chapter_id IS NULL THEN 'missing' WHEN t.level + 1 + h.height > 3 THEN 'depth' ELSE 'ok' END AS verdict FROM m JOIN h USING (node) LEFT JOIN ch t ON t.chapter_id = m.target""")
def move_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves below a target: not below oneself or one's descendants, and no deeper than three levels with all that hangs below."""
    tree = chapters(spark, sf_dir)
    parts = F.split("chapter_id", "[.]")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), ".").alias("node"), (F.size(parts) - k).alias("below"))))
    height = tree.select(up.alias("u")).groupBy("u.node").agg(F.max("u.below").alias("height"))
    cid = F.col("chapter_id")
    target = F.when(F.col("level") == 1, F.concat_ws(".", cid, cid)).when(F.col("level") == 2, "3").otherwise(F.when(F.right(cid, F.lit(1)) < "5", F.regexp_replace(cid, "[.][^.]*$", "")).otherwise(cid))
    moves = tree.select(cid.alias("node"), target.alias("target")).join(height, "node").join(tree.select(cid.alias("target"), F.col("level").alias("target_level")), "target", "left")
    verdict = F.when(F.col("node") == F.col("target"), "self").when(F.col("target").startswith(F.concat("node", F.lit("."))), "descendant").when(F.col("target_level").isNull(), "missing").when(F.col("target_level") + 1 + F.col("height") > 3, "depth").otherwise("ok")
    return moves.select("node", "target", verdict.alias("verdict"))


@Q.plan("l8_shape_checks", f"""WITH {_CH}, x AS (SELECT c.chapter_id, c.level, c.name, p.chapter_id IS NULL AND c.level > 1 AS orphan, count(k.chapter_id) AS children FROM (SELECT *, regexp_replace(chapter_id, '[.][^.]*$', '') AS up FROM ch) c LEFT JOIN ch p ON p.chapter_id = c.up AND c.level > 1 LEFT JOIN (SELECT *, regexp_replace(chapter_id, '[.][^.]*$', '') AS up FROM ch WHERE level > 1) k ON k.up = c.chapter_id GROUP BY ALL)
SELECT chapter_id, children = 0 AND level < 3 AS shell, level > 1 AND regexp_matches(name, '[0-9]$') AS residual, orphan, level >= 4 AS deep, children > 8 AS wide FROM x""")
def shape_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline's faults: shells (nothing below), ordinals left in names, orphans, depth, too many children."""
    tree = chapters(spark, sf_dir).withColumn("up", F.when(F.col("level") > 1, F.regexp_replace("chapter_id", "[.][^.]*$", "")))
    counts = tree.where("up IS NOT NULL").groupBy(F.col("up").alias("chapter_id")).agg(F.count(F.lit(1)).alias("children"))
    known = tree.select(F.col("chapter_id").alias("up"), F.lit(True).alias("known"))
    rows = tree.join(counts, "chapter_id", "left").join(known, "up", "left")
    none = F.coalesce("children", F.lit(0))
    return rows.select("chapter_id", ((none == 0) & (F.col("level") < 3)).alias("shell"), ((F.col("level") > 1) & F.col("name").rlike("[0-9]$")).alias("residual"), (F.col("up").isNotNull() & F.col("known").isNull()).alias("orphan"), (F.col("level") >= 4).alias("deep"), (none > 8).alias("wide"))


@Q.plan("t1_subtree_materials", f"""WITH {_CH}, m AS (SELECT 'r' AS kind, n_regionkey || '.' || n_nationkey AS node, s_suppkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'r', n_regionkey || '.' || n_nationkey || '.' || c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT node AS chapter_id, count(*) AS n, sum(id) AS total FROM m GROUP BY 1), d AS (SELECT ch.chapter_id, count(*) AS n, sum(id) AS total FROM ch JOIN m ON starts_with(m.node, ch.chapter_id || '.') GROUP BY 1)
SELECT chapter_id, coalesce(o.n, d.n, 0) AS materials, coalesce(o.total, d.total, 0)::BIGINT AS id_sum, o.n IS NOT NULL AS own FROM ch LEFT JOIN o USING (chapter_id) LEFT JOIN d USING (chapter_id)""")
def subtree_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter's own materials, else all of its descendants' (repeats kept): sums of each material over the numbers above its chapter."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(".", "n_regionkey", "n_nationkey").alias("up")))  # a fixed table
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("up").alias("node"), F.col("s_suppkey").alias("id"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(".", "up", "c_custkey"), "o_orderkey")
    return folds.rolled_up(chapters(spark, sf_dir), s.union(o).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))).select("chapter_id", F.coalesce("n", "below_n", F.lit(0)).alias("materials"), F.coalesce("total", "below_total", F.lit(0)).alias("id_sum"), F.col("n").isNotNull().alias("own"))


@Q.plan("t6_page_set", "WITH s AS (SELECT o_custkey AS id, (o_orderkey % 40)::BIGINT AS lo, (o_orderkey % 40 + o_orderkey % 17)::BIGINT AS hi FROM orders), p AS (SELECT DISTINCT id, unnest(CASE WHEN hi - lo <= 10 THEN range(lo, hi + 1) ELSE [lo] END) AS page FROM s) SELECT id, min(page) AS first_page, count(*) AS n, string_agg(page::VARCHAR, ' ' ORDER BY page) AS pages FROM p GROUP BY 1")
def page_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a customer's spans: a span of more than ten pages counts its first only."""
    lo = F.col("o_orderkey") % 40
    hi = lo + F.col("o_orderkey") % 17
    pages = F.explode(F.when(hi - lo <= 10, F.sequence(lo, hi)).otherwise(F.array(lo)))
    sets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), pages.alias("page")).groupBy("id").agg(F.sort_array(F.collect_set("page")).alias("p"))
    return sets.select("id", F.array_min("p").alias("first_page"), F.size("p").cast("long").alias("n"), F.array_join(F.transform("p", lambda x: x.cast("string")), " ").alias("pages"))


@Q.plan("t4_best_anchor", """WITH q AS (SELECT item_id, lower(regexp_replace(text, '[ \\t\\r\\n]+', '', 'g')) AS q FROM benchmark), l AS (SELECT doc_id, i - 1 AS pos, lower(regexp_replace(l[i], '[ \\t\\r\\n]+', '', 'g')) AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
h AS (SELECT item_id, doc_id, pos, CASE WHEN contains(b, q) AND length(q) >= 6 THEN 1000 + least(length(q), 200) WHEN contains(q, b) AND length(b) >= 8 THEN 600 + least(length(b), 120) END AS score FROM q JOIN l ON contains(b, q) OR contains(q, b))
SELECT item_id, doc_id, pos, score FROM h WHERE score >= 604 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, pos) = 1""")
def best_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that best locates an item: one that holds it, or that it holds; both meet through a part of 8 characters that the held one begins with."""
    squeeze = lambda c: F.lower(F.regexp_replace(c, "[ \t\r\n]+", ""))
    q = table(spark, sf_dir, "benchmark").select("item_id", squeeze("text").alias("q")).where("length(q) >= 6")
    b = lines(spread(table(spark, sf_dir, "documents"))).select("doc_id", "pos", squeeze("line").alias("b")).where("length(b) >= 6")
    found = T.held_in(q, "q", b, "b", 6).where(F.col("b").contains(F.col("q"))).withColumn("score", 1000 + F.least(F.length("q"), F.lit(200)))
    holds = T.held_in(b.where("length(b) >= 8"), "b", q, "q", 8).where(F.col("q").contains(F.col("b")) & (F.col("q") != F.col("b"))).withColumn("score", 600 + F.least(F.length("b"), F.lit(120)))
    every = found.select("item_id", "doc_id", "pos", "score").unionByName(holds.select("item_id", "doc_id", "pos", "score"))
    best = every.where("score >= 604").groupBy("item_id").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"), (-F.col("pos")).alias("p"))).alias("x"))
    return best.select("item_id", (-F.col("x.d")).alias("doc_id"), (-F.col("x.p")).cast("long").alias("pos"), F.col("x.score").cast("long").alias("score"))


def pages_of(text: Column, size: int = 600) -> Column:
    """A text's pages of `size` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


@Q.plan("c21_circular_page", """WITH p AS (SELECT doc_id, i AS page, (length(text) - 1) // 600 + 1 AS n, lower(substr(text, i * 600 + 1, 600)) AS x FROM (SELECT doc_id, text, unnest(range(0, (greatest(length(text), 1) - 1) // 600 + 1)) AS i FROM documents)),
f AS (SELECT DISTINCT doc_id, w AS f, length(w) AS k FROM (SELECT doc_id, unnest(string_split(lower(split_part(text, chr(10), 2)), ' ')) AS w FROM documents) WHERE length(w) >= 6), t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, f) <= 6),
h AS (SELECT p.doc_id, page, n, t.f, t.k FROM p JOIN t ON t.doc_id = p.doc_id AND contains(p.x, t.f))
SELECT doc_id, page, f AS fragment FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, f, (page - 1 + n) % n) = 1""")
def circular_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a document that holds the longest of its second line's fragments, searched from the second page on and around."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paged = pages_of(F.col("text"))
    p = docs.select("doc_id", F.size(paged).alias("n"), F.posexplode(paged).alias("page", "x")).withColumn("x", F.lower("x"))
    words = F.array_distinct(F.filter(F.split(F.lower(F.get(F.split("text", "\n"), F.lit(1))), " "), lambda w: F.length(w) >= 6))
    ranked = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("k"), w.alias("f")))), 1, 6)
    t = docs.select("doc_id", F.explode(ranked).alias("t")).select("doc_id", "t.k", "t.f")
    turn = (F.col("page") - 1 + F.col("n")) % F.col("n")
    best = p.join(t, "doc_id").where(F.col("x").contains(F.col("f"))).groupBy("doc_id").agg(F.min(F.struct("k", "f", turn.alias("turn"), "page")).alias("b"))
    return best.select("doc_id", F.col("b.page").cast("long").alias("page"), F.col("b.f").alias("fragment"))


@Q.plan("m4_composition", """WITH l AS (SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
c AS (SELECT doc_id, 1 AS source, pos * 1000 + j AS ord, s[j] AS name FROM (SELECT doc_id, pos, string_split(line, '|') AS s, unnest(range(1, len(string_split(line, '|')) + 1)) AS j FROM l WHERE contains(line, '|'))
  UNION ALL SELECT doc_id, 2, pos, line FROM l WHERE regexp_matches(line, '^[A-Z][a-z]+ of ') UNION ALL SELECT doc_id, 3, pos, line FROM l WHERE length(line) BETWEEN 4 AND 60
  UNION ALL SELECT doc_id, 4, j, s[j] FROM (SELECT doc_id, string_split(line, ',') AS s, unnest(range(1, len(string_split(line, ',')) + 1)) AS j FROM l WHERE pos = 1)),
k AS (SELECT doc_id, source, ord, regexp_replace(replace(lower(name), ' ', ''), '^[.,;:()-]+|[.,;:()-]+$', '', 'g') AS key FROM c), u AS (SELECT k.doc_id, source, key, min(ord) AS ord FROM k JOIN l AS p ON p.doc_id = k.doc_id AND p.pos = 0 WHERE key <> '' AND key <> regexp_replace(replace(lower(p.line), ' ', ''), '^[.,;:()-]+|[.,;:()-]+$', '', 'g') GROUP BY ALL),
s AS (SELECT doc_id, source, count(*) AS n, CASE source WHEN 1 THEN 40 WHEN 2 THEN 20 WHEN 3 THEN 10 ELSE 0 END + 5 * least(count(*), 20) AS score FROM u GROUP BY doc_id, source HAVING count(*) >= 2),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, source) = 1)
SELECT w.doc_id, w.source, w.n, w.score, (SELECT string_agg(key, '/' ORDER BY ord) FROM u WHERE u.doc_id = w.doc_id AND u.source = w.source) AS names FROM w""")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document consists of, by four readings: cells of its tables, titled parts, short lines, and the list in its second line.

    Within a reading a key counts once and the document's own title (its parent) not at all; a reading has two rows at least; the best
    by its kind and number of rows wins, the earlier kind where they tie.
    """
    rows = lines(table(spark, sf_dir, "documents"))
    line, none = F.col("line"), F.array().cast("array<struct<source:int,at:int,name:string>>")
    item = lambda source, at, name: F.struct(F.lit(source).alias("source"), at.cast("int").alias("at"), name.alias("name"))
    split = lambda source, mark, first: F.transform(F.split(line, mark), lambda x, j: item(source, first + j + 1, x))
    readings = [
        F.when(line.contains("|"), split(1, "[|]", F.col("pos") * 1000)).otherwise(none), F.when(line.rlike("^[A-Z][a-z]+ of "), F.array(item(2, F.col("pos"), line))).otherwise(none),
        F.when(F.length(line).between(4, 60), F.array(item(3, F.col("pos"), line))).otherwise(none), F.when(F.col("pos") == 1, split(4, ",", F.lit(0))).otherwise(none),
    ]
    found = rows.select("doc_id", F.explode(F.concat(*readings)).alias("c")).select("doc_id", "c.source", "c.at", T.outline_key(F.col("c.name")).alias("key"))
    title = rows.where("pos = 0").select("doc_id", T.outline_key(line).alias("title"))
    once = found.join(title, "doc_id").where("key <> '' AND key <> title").groupBy("doc_id", "source", "key").agg(F.min("at").alias("at"))
    read = once.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]), "/").alias("names")).where("n >= 2")
    bonus = F.when(F.col("source") == 1, 40).when(F.col("source") == 2, 20).when(F.col("source") == 3, 10).otherwise(0)
    scored = read.withColumn("score", bonus + 5 * F.least("n", F.lit(20)))
    return merging.first_by(scored, ["doc_id"], [F.desc("score"), "source"]).select("doc_id", "source", "n", "score", "names")
