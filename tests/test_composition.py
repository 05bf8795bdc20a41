"""Composition lists against loops that follow one introduction or anchor at a time; sections that are no lists by cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docquarry.operators import composition as C


def children(lines, least=3):
    for i, line in enumerate(lines):
        m = re.match(r"\d+(?:\.\d+){1,3}", line or "")
        if "list:" not in (line or "") or not m:
            continue
        took = []
        for j in range(i + 1, len(lines)):
            n = re.match(r"\d+(?:\.\d+){1,4}", (lines[j] or "").strip())
            if not n or not n[0].startswith(m[0] + "."):
                if took:
                    break
            elif n[0].count(".") == m[0].count(".") + 1:
                took.append(j)
        if len(took) >= least:
            return [(i, j) for j in took]
    return []


def test_numbered_children(spark):
    r = random.Random(2)
    line = lambda: r.choice([None, "", "text", f"1.{r.randint(1, 2)} list: x", *[f" 1.1.{r.randint(1, 9)} item"] * 12, f"1.2.{r.randint(1, 9)}item", "1.1.2.3 deep", "1.1.2.1 list:", "1.1.2.1.7 list:", "2.1 else", "list: none"])
    docs = {d: [line() for _ in range(r.choice([1, 10, 30]))] for d in range(80)}
    rows = [(d, i, x) for d, xs in docs.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "d int, n int, x string").repartition(5)
    got = {}
    for g in C.numbered_children(df, "d", "n", "x", F.contains("x", F.lit("list:"))).collect():
        got.setdefault(g["d"], []).append((g["intro"], g["pos"]))
    want = {d: w for d, xs in docs.items() if (w := children([x if x is None else x.strip() for x in xs]))}
    assert len(want) > 5 and {d: sorted(x) for d, x in got.items()} == want
    assert C.numbered_children(df.limit(0), "d", "n", "x", F.lit(True)).collect() == []
    lost = spark.createDataFrame([(None, 0, "1.1 list:"), (None, 1, "1.1.1 a"), (None, 2, "1.1.2 b"), (None, 3, "1.1.3 c")], "d int, n int, x string")
    assert len(C.numbered_children(lost, "d", "n", "x", F.contains("x", F.lit("list:"))).collect()) == 3


def followed(sections, start):
    took = []
    for i in range(start + 1, len(sections)):
        title, flags = sections[i]
        size = len("".join((title or "").split()))
        if not size:
            continue
        if took and (flags["unified"] or flags["stop"]):
            break
        if (took and flags["detail"]) or flags["header"]:
            continue
        if flags["wrapper"]:
            if took and not (flags["closing"] and len(took) >= C.CLOSING) or not took and size <= C.WRAPPER:
                continue
            break
        if took and flags["left_out"]:
            continue
        if flags["item"]:
            took.append(i)
        elif took or size > C.BEFORE:
            break
    return took if len(took) >= C.UNMARKED or len(took) >= C.MARKED and any(sections[i][1]["marked"] for i in took) else []


@pytest.mark.parametrize("items", [0.5, 0.9])
def test_following_titles(spark, items):
    r = random.Random(items)
    rates = {"item": items, "closing": 0.5, "wrapper": 0.15}
    section = lambda: (r.choice([None, "  ", "short", "x " * 30, "y" * 32]), {t: r.choice([True]) if r.random() < rates.get(t, 0.04) else r.choice([False, None]) for t in C.TITLES})
    docs = {d: [section() for _ in range(r.choice([1, 40, 90]))] for d in range(30)}
    anchors = {(d, i) for d, x in docs.items() for i in range(len(x)) if r.random() < 0.3}
    rows = [(d, i, t, (d, i) in anchors, *[f[k] for k in C.TITLES]) for d, x in docs.items() for i, (t, f) in enumerate(x)]
    df = spark.createDataFrame(rows, "d int, n int, title string, a boolean, " + ", ".join(f"{t} boolean" for t in C.TITLES)).repartition(5)
    got = {tuple(g) for g in C.following_titles(df, "d", "n", "title", "a").collect()}
    want = {(d, i, j) for d, i in anchors for j in followed(docs[d], i)}
    assert len(want) > 20 and got == want
    assert C.following_titles(df.limit(0), "d", "n", "title", "a").collect() == []


def test_clauses(spark):
    cases = [
        ("投标 保证金凭证", "否决", "没收", False),  # the title names a proof
        ("废标 条款", None, None, True),
        ("其他", "无效 响应", None, True),
        ("投标保证金", "", "不予退还", True),
        ("投标保证金", "", "退还保证金的时间", True),
        ("投标保证金", "", "提供保证金保函，退还保证金", False),  # a proof is named, and no forfeit
        ("投标保证金", "", "提供保证金保函，否则没收", True),
        ("投标保证金", "", "x" * 1800 + "没收", False),
        ("其他", "", "没收", False),
        (None, None, None, False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, r string, c string, want boolean")
    got = df.select("i", "want", C.risk_clause(F.col("t"), F.col("r"), F.col("c")).alias("got")).orderBy("i").collect()
    assert [(g["i"], g["got"]) for g in got] == [(g["i"], g["want"]) for g in got]


def test_review_tables(spark):
    head = "评审内容 | 是否 符合"
    cases = [
        ("x", head, True),
        ("x", "评审内容\n是否符合", False),  # neither bar nor table
        ("自查表", "评审内容\n是否符合", True),
        ("x", "表\n评审内容\n是否符合", True),
        ("x", "应包括:\n" + head, False),
        ("x", head + "\n应包括:", True),
        ("x", "应包括:\n评审内容 |\n是否符合", True),  # no line with both words
        ("x", "评审内容 | 其他", False),
        ("x", "\n" * 80 + head, False),
        (None, None, False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, c string, want boolean")
    got = df.select("i", "want", C.review_table(F.col("t"), F.col("c"), "应包括").alias("got")).orderBy("i").collect()
    assert [(g["i"], g["got"]) for g in got] == [(g["i"], g["want"]) for g in got]
