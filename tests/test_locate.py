"""Section resolve: every branch of the cascade, on a few rows and on documents."""

import pytest
from pyspark.sql import functions as F

from docquarry import catalog
from docquarry.operators import locate


def test_every_branch_is_reached(spark):
    got = catalog.QUERIES["c2_section_resolve"](spark, "/root/testdata/sf0.01").groupBy("found", "source").count().collect()
    seen = {(r.found, r.source) for r in got}
    assert {f for f, _ in seen} == {"id", "exact", "part"} and {s for _, s in seen} == {"own", "candidate", "range", "title"}


SECTIONS = [  # doc_id, sec_id, ord, title, content, start
    (1, "1", 1, "Scope", "", 0), (1, "2", 2, "Terms of Use", "terms text", 3), (1, "3", 3, " Scope ", "scope text", 6), (1, "4", 4, "Forms, annexes", None, 9), (1, "5", 5, "Alone", " \n", None),
    (1, "2", 6, "Second of that id", "later", 12), (2, "1", 1, "Scope", "other document", 0), (1, "7", 7, "", "no title", 15),
]
BLOCKS = [(1, 0, "Scope"), (1, 1, "b1"), (1, 2, ""), (1, 9, "Forms"), (1, 10, "f1"), (1, 11, "f2"), (1, 12, "x"), (2, 1, "elsewhere")]


@pytest.mark.parametrize(
    ("section_id", "title", "want"),
    [
        ("1", "anything", ("1", "b1", "id", "range")),  # no candidate of that title, so its blocks
        ("1", "Scope", ("3", "scope text", "id", "candidate")),
        ("2", "Scope", ("2", "later", "id", "own")),  # the last of equal ids
        ("?", "Terms of Use", ("2", "terms text", "exact", "own")),
        ("?", "Scope", ("3", "scope text", "exact", "candidate")),
        ("?", "Terms: of", ("2", "terms text", "part", "own")),
        ("?", "Our Terms of Use, new", ("2", "terms text", "part", "own")),
        ("?", "Forms annexes", ("4", "f1\nf2", "part", "range")),
        ("?", "Alone", ("5", "Alone", "exact", "title")),
        ("?", "nowhere", None), ("?", None, None), (None, "", ("7", "no title", "exact", "own")), (None, None, None), ("?", ".,", None),
    ],
)
def test_branches(spark, section_id, title, want):
    sections = spark.createDataFrame(SECTIONS, "doc_id long, sec_id string, ord long, title string, content string, start long")
    blocks = spark.createDataFrame(BLOCKS, "doc_id long, pos long, text string")
    located = spark.createDataFrame([(1, 5, section_id, title)], "doc_id long, ref long, section_id string, section_title string")
    got = [tuple(r) for r in locate.resolve(located, sections, blocks, F.col("title") == "Alone").select("sec_id", "content", "found", "source").collect()]
    assert got == ([want] if want else [])


def test_titles_meet_without_loss(spark):
    words = ["a", "ab", "abc", "abcd", "bcd", "xabcdx", "日本", "日本語版", "abcdabcd", ""]
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "doc_id long, i long, key string")
    got = locate.held_pairs(df.withColumnRenamed("key", "s"), df.selectExpr("doc_id", "i AS j", "key AS t"), "doc_id", "s", "t")
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, s in enumerate(words) for j, t in enumerate(words) if s and s in t)
    assert locate.resolve(df.selectExpr("doc_id", "i AS ref", "key AS section_id", "key AS section_title").limit(0), spark.createDataFrame(SECTIONS, "doc_id long, sec_id string, ord long, title string, content string, start long"), spark.createDataFrame(BLOCKS, "doc_id long, pos long, text string")).count() == 0


def test_contents_stay_out_of_the_cascade(spark):
    """Contents and blocks cross few shuffles, however many branches look at a section's title."""
    sections = spark.createDataFrame([(d, str(i), i, f"Title {i % 3}", "c" * 5000 if i % 2 else "", i * 2) for d in range(20) for i in range(10)], "doc_id long, sec_id string, ord long, title string, content string, start long")
    blocks = spark.createDataFrame([(d, p, "b" * 5000) for d in range(20) for p in range(20)], "doc_id long, pos long, text string")
    located = sections.select("doc_id", F.col("ord").alias("ref"), F.lit("?").alias("section_id"), F.concat("title", F.when(F.col("ord") % 2 == 0, " more").otherwise("")).alias("section_title"))
    plan = locate.resolve(located, sections, blocks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 12, plan.count("Exchange")  # 75 where every branch carried its texts


def test_repeated_sections_give_one_row_each(spark):
    sections = spark.createDataFrame([(1, "a", 1, "Scope", "text", 0)] * 3 + [(1, "b", 1, "Other", "", 3)] * 2, "doc_id long, sec_id string, ord long, title string, content string, start long")
    blocks = spark.createDataFrame([(1, 4, "x"), (1, 5, "y")], "doc_id long, pos long, text string")
    located = spark.createDataFrame([(1, 1, "a", None), (1, 2, "?", "Scope"), (1, 3, None, "Oth")], "doc_id long, ref long, section_id string, section_title string")
    got = sorted((r.ref, r.sec_id, r.content, r.source) for r in locate.resolve(located, sections, blocks).collect())
    assert got == [(1, "a", "text", "own"), (2, "a", "text", "own"), (3, "b", "x\ny", "range")]
