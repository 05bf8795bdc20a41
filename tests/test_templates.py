"""Template evidence: similarity of titles and spans of headings against the rules, pair by pair."""

import difflib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docquarry import catalog
from docquarry.functions import text as T
from docquarry.operators import similar
from docquarry.plans import templates

DIR = "/root/testdata/sf0.001"


def clean(t):
    t = re.sub(r"^(?:[0-9]+(?:[.][0-9]+)*[.)、]?|[(][0-9a-z]{1,3}[)]|[-*•])[ ]*", "", t.strip(" "))
    t = re.sub(r"[ .…]{2,}[0-9]+$", "", t).strip(" ")
    return re.sub(r"^[.,;:]+|[.,;:]+$", "", t).lower()


def words(t):
    t = re.sub("[《》〈〉“”\"'0-9]", "", re.sub("[（(].*?[）)]", "", clean(t)))
    return {w for w in (x.strip("：:.-—_ ") for x in re.split(r"[、，,；;/\s]+", t)) if len(w) >= 2}


def score(a, b):
    x, y = (re.sub(r"[《》〈〉“”\"'（）()\s]", "", clean(t)) for t in (a, b))
    if not x or not y:
        return 0.0
    grams = lambda t: Counter([t] if len(t) <= 2 else [t[i : i + 2] for i in range(len(t) - 1)])
    g, h = grams(x), grams(y)
    pairs = sum(g[k] * h[k] for k in g) / math.sqrt(sum(v * v for v in g.values()) * sum(v * v for v in h.values()))
    u, v = words(a), words(b)
    word = len(u & v) / max(len(u | v), 1)
    if any(min(len(p), len(q)) >= 3 and (p in q or q in p) for p in u for q in v):
        word = max(word, 0.75)
    return round(max(0.45 * difflib.SequenceMatcher(None, x, y).ratio() + 0.35 * pairs + 0.2 * word, word), 6)


def test_similar_titles_lose_none(spark):
    rng = random.Random(9)
    parts = ["price list", "Price", "lists", "terms of use", "(a) form", "1.2 Form", "forms", "日本", "日", "ab", "a", "b", "quality plan", "plan of quality", "x.y", ""]
    titles = sorted({" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(90)})
    left = spark.createDataFrame([(i % 2, t) for i, t in enumerate(titles)] + [(0, None)], "doc long, title string")
    right = spark.createDataFrame([(j, t) for t in titles for j in (0, 1)], "doc long, title string")
    got = {(r.doc, r.a, r.b): r.score for r in similar.similar_titles(left, right, "doc").collect()}
    want = {(i % 2, a, b): s for i, a in enumerate(titles) for b in titles if (s := score(a, b)) >= similar.LEAST and a.strip() and b.strip()}
    assert got == pytest.approx(want) and 200 < len(want) < len(titles) ** 2 / 2
    with pytest.raises(ValueError):
        similar.similar_titles(left, right, "doc", 0.5)


def spans(text):
    """(title, start, end, chars, piped) of a text's headings."""
    lines = text.split("\n")
    level = [0 if not 1 <= len(x.strip(" ")) <= 60 else 1 if len(x) <= 20 else 2 if len(x) <= 40 else 3 for x in lines]
    for i, k in enumerate(level):
        if k:
            end = next((j for j in range(i + 1, len(lines)) if 0 < level[j] <= k), len(lines))
            yield lines[i], i, end, sum(len(x.strip(" ")) for x in lines[i + 1 : end]), sum("|" in x for x in lines[i + 1 : end])


def test_spans(spark):
    got = sorted(map(tuple, templates.template_spans(templates.numbered_lines(spark, DIR)).collect()))
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("text IS NOT NULL").collect()
    assert got == sorted((r.doc_id, *s) for r in docs for s in spans(r.text))


def test_query_against_rules(spark):
    rows = templates.numbered_lines(spark, DIR)
    asked = templates.asked_sections(templates.line_sections(rows)).collect()
    by_doc = defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        by_doc[r.doc_id] = list(spans(r.text or ""))
    got = catalog.QUERIES["m6_template_evidence"](spark, DIR).collect()
    located = {(r.doc_id, r.ref) for r in got if r.how == "located"}
    want = []
    for r in asked:
        if (r.doc_id, r.ref) not in located:
            best = min(((-score(r.section_title, s[0]), s[1], s) for s in by_doc[r.doc_id]), default=None)
            if best and -best[0] >= similar.LEAST and (best[2][4] or best[2][3] >= 60):
                want.append((r.doc_id, r.ref, best[1], best[2][2], -best[0]))
    assert sorted((r.doc_id, r.ref, r.start, r.end, round(r.score, 5)) for r in got if r.how == "similar") == sorted((*w[:4], round(w[4], 5)) for w in want)
    assert len(want) > 20 and len(located) > 20
    found = catalog.QUERIES["c2_section_resolve"](spark, DIR).where("found <> 'part' AND source <> 'title'").where(F.col("content").contains("|") | (F.length("content") >= 60))
    assert located == {(r.doc_id, r.ref) for r in found.collect()}


def test_evidence_is_planned_in_parts(spark):
    plan = catalog.QUERIES["m6_template_evidence"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 40, plan.count("Exchange")  # 382 where all was one plan, which took the driver's memory


def test_excerpt_edges(spark):
    long = "x" * 700 + " thing the"
    texts = {1: long, 2: "\n".join(["no word"] * 3), 3: "\n".join(["the end of it all, with some words"] * 30), 4: "the first line of all\nHead\nthing after the boundary here", 5: "", 6: "the\n" + "y" * 598 + "\nthing"}
    df = spark.createDataFrame([(i, p, x) for i, t in texts.items() for p, x in enumerate(t.split("\n"))], "doc_id long, pos long, line string")
    got = {r.doc_id: (r.start, r.end, r.points, r.excerpt) for r in templates.best_excerpts(df).collect()}
    assert got[1] == (0, 0, 13, long[:420] + " ... " + long[-180:])
    assert got[3][:3] == (0, 16, 85)  # seventeen lines of 34 characters and a break fill 594
    assert got[4][:3] == (1, 2, 15)  # a boundary begins a run, but none goes on past one
    assert got[6][:3] == (2, 2, 8)
    assert set(got) == {1, 3, 4, 6}


def test_keyword_cut_edges(spark):
    text = "a" * 60 + "\nkey one\nother\nkey one\nkey " + "z" * 50 + "\nkey 2\n" + "b" * 40
    rows = spark.createDataFrame([(0, text), (1, "short"), (2, None), (3, "c" * 101)], "i long, t string")
    got = {r.i: r.t for r in rows.select("i", T.keyword_cut(F.col("t"), 100, ("key",)).alias("t")).collect()}
    assert got == {0: "a" * 45 + "\nkey one\nkey 2\n" + "b" * 15, 1: "short", 2: None, 3: "c" * 45 + "\n" + "c" * 15}
