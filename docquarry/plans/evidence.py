"""Spans, markers, nested values and cascades over the fixtures of plans.assembly; each counterpart is written from the rule, or from what its rows were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import folds, merging, sections, trees
from docquarry.plans.assembly import _CH, _S, chapters, stream
from docquarry.plans.query import Catalog, table
from docquarry.sources.readers import lines

Q = Catalog()
_LINES = "l AS (SELECT doc_id, i - 1 AS pos, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


@Q.plan("a9_bundle_scan", f"""WITH {_S}, t AS (SELECT *, max(n) FILTER (lv = 1) OVER w AS p1, max(n) FILTER (lv = 2) OVER w AS p2, max(n) FILTER (lv = 3) OVER w AS p3 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, CASE WHEN p2 > coalesce(p1, 0) THEN p2 END AS q2, CASE WHEN p3 > greatest(coalesce(p1, 0), coalesce(p2, 0)) THEN p3 END AS q3 FROM t WHERE event_type = 'purchase')
SELECT user_id, n, 'h' || p1 AS category, CASE WHEN q3 IS NOT NULL THEN 'h' || q2 END AS subcategory, 'h' || coalesce(q3, q2, p1) AS name, CASE event_id % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' ELSE 'other' END AS kind FROM x WHERE coalesce(q3, q2, p1) IS NOT NULL""")
def bundle_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images (purchases) under their open headings: category of level 1, subcategory of level 2 if there is a deeper one, name of the deepest; kinds by their first bytes."""
    before = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = stream(spark, sf_dir)
    for k in (1, 2, 3):
        rows = rows.withColumn(f"p{k}", F.max(F.when(F.col("lv") == k, F.col("n"))).over(before))
    zero = lambda *c: F.greatest(*[F.coalesce(x, F.lit(0)) for x in c], F.lit(0))
    q2, q3 = F.when(F.col("p2") > zero("p1"), F.col("p2")), F.when(F.col("p3") > zero("p1", "p2"), F.col("p3"))
    content = F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("FFD8FFE000"))).when(F.col("event_id") % 3 == 1, F.unhex(F.lit("89504E470D0A"))).otherwise(F.unhex(F.lit("255044")))
    starts = lambda magic: F.startswith(F.col("content"), F.unhex(F.lit(magic)))
    kind = F.when(starts("FFD8FF"), "image/jpeg").when(starts("89504E47"), "image/png").otherwise("other")
    head = lambda c: F.concat(F.lit("h"), c.cast("string"))
    images = rows.where("event_type = 'purchase'").withColumn("content", content).withColumn("deepest", F.coalesce(q3, q2, F.col("p1"))).where("deepest IS NOT NULL")
    return images.select("user_id", F.col("n").cast("long").alias("n"), head(F.col("p1")).alias("category"), F.when(q3.isNotNull(), head(q2)).alias("subcategory"), head(F.col("deepest")).alias("name"), kind.alias("kind"))


#: Settings that rows may override, one level deep.
DEFAULTS = {"image": 3, "k": 2, "report": 1}


@Q.plan("a12_policy_merge", "SELECT event_id, 3::BIGINT AS image, coalesce(json_extract_string(props, '$.k')::BIGINT, 2) AS k, 1::BIGINT AS report FROM events")
def policy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each row over the defaults: its own keys win, the others stay."""
    own = F.coalesce(F.from_json("props", "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))
    kept = F.map_filter(F.create_map(*[F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for kv in DEFAULTS.items() for x in kv]), lambda k, v: ~F.map_contains_key(F.col("own"), k))
    return table(spark, sf_dir, "events").withColumn("own", own).withColumn("policy", F.map_concat(kept, "own")).select("event_id", *[F.element_at("policy", F.lit(k)).alias(k) for k in DEFAULTS])


@Q.plan("b21_generation_skip", f"WITH {_CH} SELECT chapter_id FROM ch JOIN customer ON level = 3 AND c_custkey = regexp_extract(chapter_id, '([0-9]+)$', 1)::BIGINT WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND c_mktsegment <> 'BUILDING' AND right(c_name, 1) <> '0' AND c_nationkey NOT IN (1, 2)")
def generation_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that still need a draft: not generated, no structured material, no front matter, no authoritative source."""
    leaves = chapters(spark, sf_dir).where("level = 3").withColumn("c_custkey", F.substring_index("chapter_id", ".", -1).cast("long"))
    own = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").where(~F.col("c_nationkey").isin(1, 2)).select("c_custkey")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return leaves.where(~F.col("name").endswith("0")).join(own, "c_custkey", "left_semi").join(done, "c_custkey", "left_anti").select("chapter_id")


@Q.plan("b22_toc_pages", f"WITH {_LINES}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(line, '[a-z][.]?$') AND length(line) <= 60) AS toc FROM l WHERE pos < 30 GROUP BY 1) SELECT doc_id, n, toc FROM c WHERE n >= 5 AND toc >= greatest(3, n // 2)")
def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages like a table of contents: of the first thirty lines (five at least), three or half are short entries."""
    rows = lines(table(spark, sf_dir, "documents")).where("pos < 30")
    entry = F.col("line").rlike("[a-z][.]?$") & (F.length("line") <= 60)
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(entry).alias("toc"))
    return counts.where("n >= 5 AND toc >= greatest(3, n div 2)")


@Q.plan("c5_block_range", f"WITH {_LINES}, m AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1), s AS (SELECT doc_id, doc_id % 4 AS lo, doc_id % 4 + n // 2 AS hi FROM m), h AS (SELECT l.doc_id, pos, line FROM l JOIN s ON s.doc_id = l.doc_id AND pos BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY l.doc_id ORDER BY pos) <= 12) SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS content FROM h GROUP BY 1")
def block_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks inside a document's section, twelve at most, in order: a range join within the document."""
    rows = lines(table(spark, sf_dir, "documents"))
    spans = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", (F.col("doc_id") % 4).alias("lo"), (F.col("doc_id") % 4 + F.expr("n div 2")).alias("hi"))
    hits = rows.join(spans, "doc_id").where(F.col("pos").between(F.col("lo"), F.col("hi")))
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where("k <= 12")
    return first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"))


@Q.plan("c22_marker_spans", f"""WITH {_S}, m AS (SELECT user_id, n, event_id % 3 AS base, lag(event_id % 3) OVER (PARTITION BY user_id ORDER BY n) AS before FROM s WHERE event_type = 'signup'), g AS (SELECT user_id, n, base, lead(n) OVER (PARTITION BY user_id ORDER BY n) AS stop FROM m WHERE before IS NULL OR before <> base),
e AS (SELECT user_id, max(n) AS last FROM s GROUP BY 1), p AS (SELECT user_id, base, n AS lo, coalesce(stop - 1, last) AS hi FROM g JOIN e USING (user_id)), r AS (SELECT user_id, n, event_id % 3 AS base FROM s WHERE event_type = 'purchase')
SELECT r.user_id, r.n, min(lo) AS lo, min_by(hi, lo) AS hi FROM r JOIN p ON p.user_id = r.user_id AND p.base = r.base GROUP BY ALL""")
def marker_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to their form's span: from its first marker to the one before the next marker of another form."""
    s = stream(spark, sf_dir).withColumn("base", F.col("event_id") % 3).withColumn("n", F.col("n").cast("long"))
    order = Window.partitionBy("user_id").orderBy("n")
    marks = s.where("event_type = 'signup'").withColumn("before", F.lag("base").over(order)).where("before IS NULL OR before <> base")
    spans = marks.withColumn("stop", F.lead("n").over(order)).join(s.groupBy("user_id").agg(F.max("n").alias("last")), "user_id")
    first = spans.groupBy("user_id", "base").agg(F.min(F.struct(F.col("n").alias("lo"), F.coalesce(F.col("stop") - 1, "last").alias("hi"))).alias("s"))
    return s.where("event_type = 'purchase'").select("user_id", "base", "n").join(first, ["user_id", "base"]).select("user_id", "n", "s.lo", "s.hi")


@Q.plan("c23_child_reconcile", "WITH h AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), p AS (SELECT l_orderkey, max(l_quantity) AS q, max(l_linenumber) AS most FROM lineitem GROUP BY 1), w AS (SELECT l_orderkey, q, unnest(range(1, most + 1)) AS n FROM p) SELECT w.l_orderkey, n::INT AS n, round(w.l_orderkey + n / 10, 1) AS ord FROM w LEFT JOIN h ON h.l_orderkey = w.l_orderkey AND h.l_linenumber = w.n WHERE h.l_orderkey IS NULL AND q > 6 * n")
def child_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that an order lacks and that its evidence supports, placed behind it by a fractional key."""
    line = table(spark, sf_dir, "lineitem")
    wanted = line.groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.max("l_linenumber").alias("most")).select("l_orderkey", "q", F.explode(F.sequence(F.lit(1), "most")).alias("n"))
    lacking = wanted.join(line.select("l_orderkey", F.col("l_linenumber").alias("n")), ["l_orderkey", "n"], "left_anti").where("q > 6 * n")
    return lacking.select("l_orderkey", "n", F.round(F.col("l_orderkey") + F.col("n") / 10, 1).alias("ord"))


@Q.plan("c24_prior_evidence", "WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS anchor, o_orderkey % 5 > 0 AS resolved FROM orders), p AS (SELECT *, lag(anchor) OVER w AS before, lag(resolved) OVER w AS ok FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_orderkey, coalesce(anchor, CASE WHEN ok THEN before END) AS anchor, anchor IS NULL AND ok AND before IS NOT NULL AS copied FROM p")
def prior_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assignment without an anchor takes that of the customer's order before, if its span was resolved."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("own"), (F.col("o_orderkey") % 5 > 0).alias("resolved"))
    before, ok = F.lag("own").over(order), F.lag("resolved").over(order)
    rows = o.withColumn("before", F.when(ok, before)).withColumn("ok", ok)
    return rows.select("o_orderkey", F.coalesce("own", "before").alias("anchor"), (F.col("own").isNull() & F.col("ok") & F.col("before").isNotNull()).alias("copied"))


@Q.plan("d23_media_counts", f"""WITH {_S}, h AS (SELECT user_id, n, lv, (SELECT min(x.n) FROM s x WHERE x.user_id = s.user_id AND x.n > s.n AND x.lv <= s.lv) AS stop FROM s WHERE lv <= 3)
SELECT h.user_id, h.n, count(s.n) FILTER (s.event_type = 'purchase') AS images, count(s.n) FILTER (s.event_type = 'error') AS tables FROM h LEFT JOIN s ON s.user_id = h.user_id AND s.n > h.n AND s.n < coalesce(h.stop, 1000000000) GROUP BY ALL""")
def media_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and tables between each heading and the next of its level or above: differences of running counts at both ends."""
    order = Window.partitionBy("user_id").orderBy("n")
    rows = stream(spark, sf_dir).withColumn("level", F.when(F.col("lv") <= 3, F.col("lv")).otherwise(0)).withColumn("n", F.col("n").cast("long"))
    for kind, name in (("purchase", "i"), ("error", "t")):
        rows = rows.withColumn(name, F.sum((F.col("event_type") == kind).cast("long")).over(order))
    ended = sections.ends(rows, "user_id", "n", "level").where("level > 0")
    at_end = rows.select("user_id", (F.col("n") + 1).alias("end_pos"), F.col("i").alias("i2"), F.col("t").alias("t2"))
    return ended.join(at_end, ["user_id", "end_pos"]).select("user_id", "n", (F.col("i2") - F.col("i")).alias("images"), (F.col("t2") - F.col("t")).alias("tables"))


@Q.plan("d25_sequence_score", f"WITH {_LINES} SELECT doc_id, count(DISTINCT pos // 4) AS score FROM l WHERE pos < 80 AND regexp_matches(lower(line), 'tion|ment|keit') GROUP BY 1")
def sequence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ordinals (every four lines) of the first eighty lines name a material."""
    low = F.lower("line")
    named = low.contains("tion") | low.contains("ment") | low.contains("keit")
    return lines(table(spark, sf_dir, "documents")).where(F.col("pos") < 80).where(named).groupBy("doc_id").agg(F.countDistinct(F.expr("pos div 4")).alias("score"))


@Q.plan("f8_best_heading", f"WITH {_LINES}, s AS (SELECT doc_id, pos, 10 * contains(line, 'the')::INT + 5 * (length(line) < 80)::INT + 2 * regexp_matches(line, '^[A-Z]')::INT AS score FROM l) SELECT doc_id, pos, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos DESC) = 1")
def best_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's best heading line; of equal ones the last."""
    hit = lambda c: c.cast("long")
    score = 10 * hit(F.col("line").contains("the")) + 5 * hit(F.length("line") < 80) + 2 * hit(F.col("line").rlike("^[A-Z]"))
    best = lines(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.max(F.struct(score.alias("score"), F.col("pos").cast("long").alias("pos"))).alias("b"))
    return best.select("doc_id", "b.pos", "b.score")


#: Numbered prefixes of a heading, and the level of each.
PREFIXES = (("第3章 ", 1), ("二、", 2), ("4 ", 2), ("4.1 ", 2), ("4.1.2 ", 3), ("4.1.2.7.1 ", 4), ("(5) ", 3), ("", 0))


@Q.plan("h22_level", "SELECT p_partkey, [1, 2, 2, 2, 3, 4, 3, 0][p_partkey % 8 + 1]::INT AS level FROM part")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by the numbering before a title; the counterpart knows which prefix each row was given."""
    prefix = F.get(F.array(*[F.lit(p) for p, _ in PREFIXES]), (F.col("p_partkey") % len(PREFIXES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.heading_level(F.concat(prefix, "p_name")).alias("level"))


@Q.plan("h2_outline_key", "SELECT p_partkey, replace(lower(p_name), ' ', '') AS key FROM part")
def outline_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of headings with marks, white space and punctuation around them, which the counterpart leaves out from the start."""
    wrap = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("", " [required]"), ("【必填】"[1:3] + " ", ""), ("- ", " ："), ("（", "）;"), ("　", " [Optional]"))])
    w = F.get(wrap, (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.outline_key(F.concat(w["a"], F.upper("p_name"), w["b"])).alias("key"))


@Q.plan("h17_char_count", "SELECT p_partkey, (p_size % 5)::BIGINT AS n, p_size % 5 < 2 AS shell FROM part")
def han_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han characters behind a number: fewer than two make a shell."""
    text = F.concat((F.col("p_size") + 1).cast("string"), F.lit("、"), F.repeat(F.lit("标"), F.col("p_size") % 5), F.lit(" "), "p_name")
    bare = F.regexp_replace(text, "^[0-9]+、", "")
    n = F.regexp_count(bare, F.lit("[一-鿿]"))
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), (n < 2).alias("shell"))


@Q.plan("i2_datetime_phrase", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' || CASE WHEN o_orderkey % 3 = 1 THEN ' ' || (o_orderkey % 24) || ':30' ELSE '' END END AS phrase FROM orders")
def datetime_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first date of a sentence, with its time if one follows."""
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 3
    date = F.concat(F.year(d), F.lit("年"), F.month(d), F.lit("月"), F.dayofmonth(d), F.lit("日"))
    said = F.when(kind == 0, F.concat(F.lit("due on "), date, F.lit(" or before 2031年1月1日"))).when(kind == 1, F.concat(F.lit("until "), date, F.lit(" "), F.col("o_orderkey") % 24, F.lit(":30 sharp"))).otherwise("no date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.regexp_extract(said, "([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日(?: ?[0-9]{1,2}[:：][0-9]{2})?)", 1).alias("phrase"))


@Q.plan("j8_best_child", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity * 5)::BIGINT AS span, 3 * (l_partkey % 4) + 100 * (l_returnflag = 'R')::INT + (l_partkey % 5 IN (3, 4))::INT - greatest((l_quantity * 5)::BIGINT - 80, 0) // 20 AS score FROM lineitem WHERE l_quantity * 5 BETWEEN 1 AND 180)
SELECT l_orderkey, l_linenumber, l_partkey, score::BIGINT AS score FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_partkey) = 1""")
def best_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's best child: term hits, 100 if preferred, 1 on levels 3 and 4, less one per twenty beyond a span of 80; spans of 1 to 180 only."""
    span = (F.col("l_quantity") * 5).cast("long")
    score = 3 * (F.col("l_partkey") % 4) + 100 * (F.col("l_returnflag") == "R").cast("long") + (F.col("l_partkey") % 5).isin(3, 4).cast("long") - F.floor(F.greatest(span - 80, F.lit(0)) / 20)
    fits = table(spark, sf_dir, "lineitem").withColumn("span", span).where("span BETWEEN 1 AND 180")
    best = fits.groupBy("l_orderkey").agg(F.max(F.struct(score.alias("score"), (-F.col("l_linenumber")).alias("n"), (-F.col("l_partkey")).alias("p"))).alias("b"))
    return best.select("l_orderkey", (-F.col("b.n")).alias("l_linenumber"), (-F.col("b.p")).alias("l_partkey"), "b.score")


@Q.plan("k8_flatten", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments with nested or flat materials as rows; here lines were nested in JSON by order, every third order flat."""
    item = F.struct("l_partkey", "l_quantity")
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.when(F.col("l_orderkey") % 3 == 0, F.struct(item.alias("material"), F.lit(None).cast("bigint").alias("l_partkey"), F.lit(None).cast("double").alias("l_quantity"))).otherwise(F.struct(F.lit(None).cast("struct<l_partkey:bigint,l_quantity:double>").alias("material"), "l_partkey", "l_quantity")))).alias("json"))
    back = nested.select("l_orderkey", F.explode(F.from_json("json", "array<struct<material:struct<l_partkey:bigint,l_quantity:double>,l_partkey:bigint,l_quantity:double>>")).alias("m"))
    return back.select("l_orderkey", F.coalesce("m.material.l_partkey", "m.l_partkey").alias("l_partkey"), F.coalesce("m.material.l_quantity", "m.l_quantity").alias("l_quantity"))


@Q.plan("k10_locked_facts", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'override' WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS fact FROM customer")
def locked_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's first value that isn't blank, of its override, value and quote."""
    k = F.col("c_custkey")
    sides = F.array(F.when(k % 7 == 0, "override"), F.when(k % 3 == 0, F.col("c_name")).otherwise("  "), F.when(k % 3 == 1, F.col("c_mktsegment")).otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(F.filter(sides, lambda x: F.trim(x) != ""), F.lit(0)).alias("fact"))


@Q.plan("l5_find_node", f"WITH {_CH} SELECT word, chapter_id FROM ch, (SELECT unnest(['1', '7', 'Customer']) AS word) w WHERE contains(name, word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY list_transform(string_split(chapter_id, '.'), lambda x: x::BIGINT)) = 1")
def find_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chapter, parents before children, whose name has a word: the least path of numbers."""
    words = F.array(*map(F.lit, ("1", "7", "Customer")))
    hits = chapters(spark, sf_dir).select("chapter_id", F.explode(F.filter(words, lambda w: F.col("name").contains(w))).alias("word"))
    path = F.transform(F.split("chapter_id", "[.]"), lambda x: x.cast("long"))
    return hits.groupBy("word").agg(F.min(F.struct(path.alias("path"), "chapter_id"))["chapter_id"].alias("chapter_id"))


@Q.plan("m5_index_table", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM lineitem), f AS (SELECT *, max(CASE WHEN k % 3 = 1 THEN k END) OVER (PARTITION BY l_orderkey ORDER BY k) AS g FROM r), n AS (SELECT f.l_orderkey, f.k, f.l_partkey AS name, h.l_linenumber AS part FROM f JOIN r AS h ON h.l_orderkey = f.l_orderkey AND h.k = f.g) SELECT l_orderkey, part, name, min(k)::INT AS pos FROM n WHERE name % 10 <> 0 GROUP BY l_orderkey, part, name")
def index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables read from text: the header names the columns, empty first cells are filled from above, rows without a name and repeats go, the first other line ends it.

    The text is written here from an order's lines (each third with its part, names that end in 0 left out), so the counterpart starts from these.
    """
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", k.alias("k"))
    cell = lambda c, show: F.when(show, c.cast("string")).otherwise("")
    written = F.concat(F.lit("| "), cell(F.col("l_partkey"), F.col("l_partkey") % 10 != 0), F.lit(" | "), cell(F.col("l_linenumber"), F.col("k") % 3 == 1), F.lit(" |"))
    text = rows.groupBy("l_orderkey").agg(F.concat(F.lit("Contents\n| Name | Part |\n|---|---|\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", written.alias("w")))), lambda x: x["w"]), "\n"), F.lit("\nend of table\n| 999 | 9 |")).alias("text"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), "[|]"), lambda c: F.trim(c))
    every = lines(text, "l_orderkey").withColumn("cells", F.when(F.col("line").startswith("|"), cells))
    order = Window.partitionBy("l_orderkey").orderBy("pos")
    every = every.withColumn("head", F.first(F.when(F.array_contains("cells", "Name") & F.array_contains("cells", "Part"), F.struct("pos", "cells")), ignorenulls=True).over(order)).where("head IS NOT NULL")
    every = every.withColumn("ended", F.max(F.col("cells").isNull().cast("int")).over(order)).where("ended = 0").where(F.col("pos") > F.col("head.pos")).where(~F.col("line").rlike("^[|: -]+$"))
    at = lambda name: F.nullif(F.element_at("cells", F.array_position("head.cells", name).cast("int")), F.lit(""))
    filled = every.select("l_orderkey", (F.col("pos") - F.col("head.pos") - 1).alias("pos"), at("Name").cast("long").alias("name"), F.last(at("Part").cast("int"), ignorenulls=True).over(order).alias("part"))
    return filled.where("name IS NOT NULL").groupBy("l_orderkey", "part", "name").agg(F.min("pos").alias("pos"))


@Q.plan("m9_context", """WITH d AS (SELECT user_id, event_type || (event_id % 6) AS key, min((ts, event_id)) AS place, max(value) AS score FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS k FROM d)
SELECT user_id, round(max(score), 4) AS confidence, count(*) AS hits, string_agg(key, ' ' ORDER BY k) FILTER (k <= 8) AS top_hits FROM o GROUP BY 1""")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf's context: confidence is the best score, hits count once by key and keep their order, not their scores', of which the first eight."""
    key = F.concat("event_type", F.col("event_id") % 6)
    d = table(spark, sf_dir, "events").groupBy("user_id", key.alias("key")).agg(F.min(F.struct("ts", "event_id")).alias("at"), F.max("value").alias("score"))
    listed = d.groupBy("user_id").agg(F.round(F.max("score"), 4).alias("confidence"), F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list(F.struct("at", "key"))).alias("l"))
    return listed.select("user_id", "confidence", "hits", F.array_join(F.transform(F.slice("l", 1, 8), lambda x: x["key"]), " ").alias("top_hits"))


@Q.plan("s6_exclusive_default", "SELECT s_suppkey, s_suppkey = (SELECT arg_max(s_suppkey, (s_acctbal, s_suppkey)) FROM supplier x WHERE x.s_nationkey = s.s_nationkey AND s_acctbal >= 0) AS is_default FROM supplier s")
def exclusive_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One default per nation, its active supplier with the highest balance; all others are cleared."""
    s = table(spark, sf_dir, "supplier")
    best = s.where("s_acctbal >= 0").groupBy("s_nationkey").agg(F.max(F.struct("s_acctbal", "s_suppkey"))["s_suppkey"].alias("chosen"))
    return s.join(best, "s_nationkey", "left").select("s_suppkey", (F.col("s_suppkey") == F.col("chosen")).alias("is_default"))


@Q.plan("t2_rollup_summary", f"""WITH {_CH}, m AS (SELECT n_regionkey || '.' || n_nationkey AS node, count(*) AS n, sum(s_suppkey) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY 1 UNION ALL SELECT n_regionkey || '.' || n_nationkey || '.' || c_custkey, count(*), sum(o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT chapter_id, coalesce((SELECT n FROM m WHERE node = chapter_id), (SELECT sum(n) FROM m WHERE starts_with(node, chapter_id || '.')), 0)::BIGINT AS facts, coalesce((SELECT n FROM m WHERE node = chapter_id), (SELECT sum(n) FROM m WHERE starts_with(node, chapter_id || '.')), 0) > 0 AS has_assignment FROM ch WHERE level < 3""")
def rollup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter's own retrieval summary, else that of all below: whether anything is assigned, and how many facts."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(".", "n_regionkey", "n_nationkey").alias("up"))
    nation = F.broadcast(nation)  # a fixed table
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).where("n_nationkey % 2 = 0").select(F.col("up").alias("node"), F.col("s_suppkey").alias("id"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(".", "up", "c_custkey"), "o_orderkey")
    sums = s.union(o).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
    facts = F.coalesce("n", "below_n", F.lit(0))
    return folds.rolled_up(chapters(spark, sf_dir), sums).where("level < 3").select("chapter_id", facts.alias("facts"), (facts > 0).alias("has_assignment"))


@Q.plan("t12_keyword_filter", "SELECT doc_id, (SELECT count(*) FROM labels WHERE quality = 1) AS done FROM documents LEFT JOIN labels USING (doc_id) WHERE contains(lower(doc_id || ' ' || coalesce(lang, '') || ' ' || coalesce(source, '') || ' ' || n_chars || ' ' || coalesce(quality::VARCHAR, '')), 'fr src1')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects whose five fields, joined in lower case, hold the keyword; the counter is of all projects, not of those found."""
    labels = table(spark, sf_dir, "labels")
    done = labels.agg(F.count_if(F.col("quality") == 1).alias("done"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = table(spark, sf_dir, "documents").join(labels.select("doc_id", "quality"), "doc_id", "left").where(F.lower(F.concat_ws(" ", *map(blank, ("doc_id", "lang", "source", "n_chars", "quality")))).contains("fr src1"))
    return found.select("doc_id").join(F.broadcast(done), how="cross")  # a single row


@Q.plan("s1_result_sink", "SELECT o_custkey, count(*) AS n, 'done' AS status FROM orders GROUP BY 1")
def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON over what was there, with a status per project, and read again."""
    import uuid

    from docquarry.runtime import shared_folder
    from docquarry.sources import sinks

    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    for status in ("running", "done"):  # a project's state changes, and the last one stays
        sinks.json_lines(rows.withColumn("status", F.lit(status)), path)
    return spark.read.schema("o_custkey long, n long, status string").json(path)


@Q.plan("c12_existing_wins", 'SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CAST(l.toxic AS VARCHAR), d.lang) AS value FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id')
def existing_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values merged by key: what is there already wins unless it is blank."""
    new = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("value"))
    return merging.existing_wins(new, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("value")), "doc_id", "value")


@Q.plan("g1_keyed_union", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY md5(text) ORDER BY p, doc_id) AS n FROM (SELECT doc_id, lang, text, 0 AS p FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang, text, 1 FROM documents WHERE lang <> 'en') u) r WHERE n = 1")
def keyed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents, and the others whose text they lack; of equal texts the first. Texts meet by their digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5("text").alias("key"))
    first = lambda rows: rows.groupBy("key").agg(F.min(F.struct("doc_id", "lang")).alias("d")).select("key", "d.doc_id", "d.lang")
    return merging.union_left_wins(first(docs.where("lang = 'en'")), first(docs.where("lang <> 'en'")), ["key"]).select("doc_id", "lang")


@Q.plan("g6_last_wins", 'SELECT c_nationkey, c_mktsegment, max(c_custkey) AS winner, min(c_custkey) AS place FROM customer GROUP BY c_nationkey, c_mktsegment')
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation and segment the last customer, at the first one's place."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("winner"), F.col("c_custkey").alias("place"))
    return merging.last_wins(rows, ["c_nationkey", "c_mktsegment"], "place")


@Q.plan("h10_truncate", "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE concat(left(text, 210), ' ... ', right(text, 90)) END AS cut FROM documents")
def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to their head and tail."""
    return table(spark, sf_dir, "documents").select("doc_id", T.head_tail(F.col("text"), 300).alias("cut"))


@Q.plan("h14_no_urls", "SELECT p_partkey, length(p_name) + 4 AS n FROM part")
def url_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths without addresses, of names around which some were put."""
    text = F.concat("p_name", F.lit(" a https://x.org/y?z=1 http://b.c b"))
    return table(spark, sf_dir, "part").select("p_partkey", F.length(F.regexp_replace(T.without_urls(text), " +", " ")).cast("long").alias("n"))


@Q.plan("b10_leaf_nodes", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations below which no active supplier hangs."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), "n_nationkey")
    below = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.lit(None).cast("int"))
    return trees.leaves(nations.union(below)).where("n_nationkey IS NOT NULL").select("n_nationkey")


@Q.plan("m14_render_strategy", """WITH x AS (SELECT o_orderkey, count(l_orderkey) AS n, coalesce(bool_or(l_returnflag = 'R'), false) AS form, o_totalprice, o_orderstatus FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 GROUP BY ALL)
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'container' WHEN form THEN 'form' WHEN o_orderstatus = 'F' THEN 'generated' WHEN n > 0 THEN 'materials' ELSE 'empty' END AS strategy, n > 0 AND o_orderstatus = 'F' AS both, o_orderkey % 10 <> 0 AND n = 0 AND o_orderstatus <> 'F' AS missing FROM x""")
def render_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a node is rendered: containers, then forms, then drafts, then materials, else empty; and whether two sources meet or none is there."""
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("form"))
    rows = table(spark, sf_dir, "orders").join(line, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inner, draft = F.col("o_orderkey") % 10 == 0, F.col("o_orderstatus") == "F"
    strategy = F.when(inner, "container").when(F.coalesce("form", F.lit(False)), "form").when(draft, "generated").when(F.col("n") > 0, "materials").otherwise("empty")
    return rows.select("o_orderkey", strategy.alias("strategy"), ((F.col("n") > 0) & draft).alias("both"), (~inner & (F.col("n") == 0) & ~draft).alias("missing"))


@Q.plan("h20_table_lines", "SELECT p_partkey, [true, true, false, false, true][p_partkey % 5 + 1] AS is_row, p_partkey % 5 IN (1, 4) AS is_rule, CASE p_partkey % 5 WHEN 0 THEN p_name || '/' || p_size WHEN 1 THEN '---/:--' WHEN 4 THEN '-/-/-' END AS cells FROM part")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table lines found, told from rules, and split; the counterpart knows how each was written."""
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, F.concat(F.lit("| "), "p_name", F.lit(" |  "), "p_size", F.lit("|"))).when(k == 1, "|---|:--|").when(k == 2, F.concat("p_name", F.lit(" | "), "p_size")).when(k == 3, F.col("p_name")).otherwise(" | - | - | - |  ")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.trim(line).alias("line"))
    is_row = F.col("line").rlike(r"^\|.*\|$")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), "[|]"), lambda c: F.trim(c))
    return rows.select("p_partkey", is_row.alias("is_row"), (is_row & F.forall(cells, lambda c: c.rlike("^:?-+:?$"))).alias("is_rule"), F.when(is_row, F.array_join(cells, "/")).alias("cells"))


#: Families of a chapter by its title's words, in order, and what stands for none.
FAMILIES = (("price", ("bolt", "nut")), ("form", ("ring", "red")), ("business", ("hot", "small", "gear")))


@Q.plan("h23_chapter_type", "WITH m AS (SELECT p_partkey, list_filter([CASE WHEN regexp_matches(p_name, 'bolt|nut') THEN 'price' END, CASE WHEN regexp_matches(p_name, 'ring|red') THEN 'form' END, CASE WHEN regexp_matches(p_name, 'hot|small|gear') THEN 'business' END], lambda x: x IS NOT NULL) AS f FROM part) SELECT p_partkey, coalesce(f[1], 'technical') AS kind, array_to_string(f, ',') AS styles FROM m")
def chapter_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter's kind is its first family, technical without any; its styles are all of them."""
    rules = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, ws)).alias("ws")) for k, ws in FAMILIES])
    found = F.transform(F.filter(rules, lambda r: F.exists(r["ws"], lambda w: F.col("p_name").contains(w))), lambda r: r["k"])
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.get(found, F.lit(0)), F.lit("technical")).alias("kind"), F.array_join(found, ",").alias("styles"))


@Q.plan("h24_scoring_type", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' AND l_tax < 0.02 THEN 'method' WHEN l_discount = 0 THEN 'conformity' WHEN l_extendedprice > 40000 THEN 'price' WHEN l_partkey % 3 = 0 THEN 'technical' WHEN l_suppkey % 2 = 0 THEN 'business' WHEN l_quantity >= 25 THEN 'price' ELSE 'technical' END AS kind FROM lineitem""")
def scoring_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of scoring rows: the first rule that holds, of rules in order; sizes decide only where no word does."""
    c = F.col
    rules = [(((c("l_returnflag") == "R") & (c("l_tax") < 0.02)), "method"), (c("l_discount") == 0, "conformity"), (c("l_extendedprice") > 40000, "price"), (c("l_partkey") % 3 == 0, "technical"), (c("l_suppkey") % 2 == 0, "business"), (c("l_quantity") >= 25, "price")]
    first = F.coalesce(*[F.when(rule, F.lit(kind)) for rule, kind in rules], F.lit("technical"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", first.alias("kind"))


@Q.plan("l9_source_priority", f"WITH {_LINES}, a AS (SELECT doc_id, min(pos) AS pos FROM l WHERE contains(line, ' | ') GROUP BY 1), b AS (SELECT doc_id, min(pos) AS pos FROM l WHERE length(line) BETWEEN 1 AND 40 GROUP BY 1), c AS (SELECT doc_id, quality AS pos FROM labels) SELECT d.doc_id, CASE WHEN a.pos IS NOT NULL THEN 'table' WHEN b.pos IS NOT NULL THEN 'heading' WHEN c.pos IS NOT NULL THEN 'rows' ELSE 'none' END AS origin, coalesce(a.pos, b.pos, c.pos) AS pos FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)")
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a composition is read from: a table, else the first heading, else given rows: one pass over lines, whose least place of each kind is kept."""
    rows = lines(table(spark, sf_dir, "documents"))
    place = lambda c: F.min(F.when(c, F.struct(F.col("pos").cast("long").alias("pos")))).getField("pos")
    found = rows.groupBy("doc_id").agg(place(F.col("line").contains(" | ")).alias("a"), place(F.length("line").between(1, 40)).alias("b"))
    given = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("c"))
    origin = F.coalesce(*[F.when(F.col(x).isNotNull(), F.lit(name)) for x, name in (("a", "table"), ("b", "heading"), ("c", "rows"))], F.lit("none"))
    return found.join(given, "doc_id", "left").select("doc_id", origin.alias("origin"), F.coalesce("a", "b", "c").alias("pos"))


@Q.plan("s2_tree_outline", f"WITH {_CH} SELECT split_part(chapter_id, '.', 1) AS root, string_agg(repeat('    ', level - 1) || chapter_id || '. ' || name, chr(10) ORDER BY list_transform(string_split(chapter_id, '.'), lambda x: x::BIGINT)) AS outline FROM ch GROUP BY 1")
def tree_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree as indented text, parents before their children: one text per root, in the order of its numbers."""
    path = F.transform(F.split("chapter_id", "[.]"), lambda x: x.cast("long"))
    line = F.concat(F.repeat(F.lit("    "), F.col("level") - 1), "chapter_id", F.lit(". "), "name")
    rows = chapters(spark, sf_dir).select(F.substring_index("chapter_id", ".", 1).alias("root"), F.struct(path.alias("path"), line.alias("line")).alias("x"))
    return rows.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("outline"))


@Q.plan("t3_lookup_map", "SELECT l_partkey, l_orderkey AS anchor, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1")
def lookup_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to their last location: a pre-aggregated maximum."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(F.struct("l_orderkey", "l_linenumber")).alias("x"))
    return last.select("l_partkey", F.col("x.l_orderkey").alias("anchor"), F.col("x.l_linenumber").alias("line"))


@Q.plan("t5_fallback_chain", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'b' || o_orderkey || ' b' || (o_orderkey + 1) WHEN o_orderkey % 6 = 1 THEN 'best' || o_custkey WHEN o_orderkey % 6 = 2 THEN 'start' WHEN o_orderkey % 6 = 3 THEN 'end' WHEN o_orderkey % 6 = 4 THEN 'section' ELSE '' END AS anchors FROM orders")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirement's anchors: its blocks, else the best anchor, else start, end and section; the first list that isn't empty."""
    k = F.col("o_orderkey") % 6
    none = F.array().cast("array<string>")
    one = lambda at, c: F.when(k == at, F.array(c)).otherwise(none)
    blocks = F.when(k == 0, F.array(F.concat(F.lit("b"), "o_orderkey"), F.concat(F.lit("b"), F.col("o_orderkey") + 1))).otherwise(none)
    chain = F.array(blocks, one(1, F.concat(F.lit("best"), "o_custkey")), one(2, F.lit("start")), one(3, F.lit("end")), one(4, F.lit("section")))
    first = F.coalesce(F.get(F.filter(chain, lambda x: F.size(x) > 0), F.lit(0)), none)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(first, " ").alias("anchors"))


@Q.plan("k9_summary", "WITH p AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'P'), l AS (SELECT o_custkey, array_to_string(list_sort(list(p))[1:3], ', ') AS ps FROM p GROUP BY 1), t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, left('customer ' || o_custkey || '; orders: ' || n || coalesce('; priorities: ' || ps, ''), 60) AS summary FROM t LEFT JOIN l USING (o_custkey)")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object in words: empty fields go, lists keep three, the whole keeps sixty characters."""
    kept = F.slice(F.sort_array(F.collect_set(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))), 1, 3)
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), kept.alias("ps"))
    fields = F.array(F.concat(F.lit("customer "), "o_custkey"), F.concat(F.lit("orders: "), "n"), F.when(F.size("ps") > 0, F.concat(F.lit("priorities: "), F.array_join("ps", ", "))))
    return rows.select("o_custkey", F.left(F.array_join(F.filter(fields, lambda f: f.isNotNull()), "; "), F.lit(60)).alias("summary"))


@Q.plan("t8_group_kind", f"WITH {_LINES}, g AS (SELECT doc_id, lower(max(line) FILTER (pos = 0)) AS title, count(*) AS n, bool_or(contains(line, 'tion')) AS t, bool_or(contains(line, 'ment')) AS b FROM l GROUP BY 1) SELECT CASE WHEN contains(title, 'tion') THEN 'technical' WHEN contains(title, 'ment') THEN 'business' WHEN t THEN 'technical' WHEN b THEN 'business' ELSE 'other' END AS kind, count(*) AS groups, sum(n)::BIGINT AS n FROM g GROUP BY 1")
def group_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by their title's words, else by their rows' words, with their numbers of rows."""
    has = lambda w: F.bool_or(F.col("line").contains(w))
    g = lines(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.max(F.when(F.col("pos") == 0, F.lower("line"))).alias("title"), F.count(F.lit(1)).alias("n"), has("tion").alias("t"), has("ment").alias("b"))
    kind = F.when(F.col("title").contains("tion"), "technical").when(F.col("title").contains("ment"), "business").when(F.col("t"), "technical").when(F.col("b"), "business").otherwise("other")
    return g.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"))
