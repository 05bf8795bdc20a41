"""Folds, tolerant reading and lossless candidates against plain loops; plans without nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry import catalog
from docquarry.functions import text as T
from docquarry.operators import folds, merging
from docquarry.plans.extraction import tolerant


def placed(rows):
    """rows of a document in order: (n, level, name, parent name)."""
    at, open_now, out = {}, {}, []
    for n, _, name, _ in rows:
        at.setdefault(name, n)
    for n, level, _, wanted in rows:
        parent = at.get(wanted)
        if parent is None or parent == n:
            parent = next((open_now[k] for k in range(level - 1, 0, -1) if k in open_now), None)
        level = 1 if parent is None else level
        open_now = {k: v for k, v in open_now.items() if k < level} | {level: n}
        out.append((n, parent, level))
    return out


def test_place_in_outline(spark):
    rng = random.Random(3)
    docs = {d: [(n, rng.randint(1, 4), rng.choice("abcdefgh"), rng.choice(["", "", "a", "c", "zz"])) for n in range(1, rng.randint(2, 15))] for d in range(60)}
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], "d long, n int, lv int, name string, up string").repartition(3)
    got = {d: [] for d in docs}
    for r in folds.place_in_outline(df, "d", "n", "lv", "name", "up").collect():
        got[r.d].append((r.n, r.parent, r.level))
    assert {d: sorted(v) for d, v in got.items()} == {d: placed(rows) for d, rows in docs.items()}
    assert folds.place_in_outline(df.limit(0), "d", "n", "lv", "name", "up").count() == 0


def test_smooth_levels(spark):
    rng = random.Random(4)
    number = lambda: ".".join(str(rng.randint(1, 3)) for _ in range(rng.randint(1, 5)))
    docs = {d: [(n, rng.choice([f"{number()} T", f"{number()}. T", "T", None]), rng.randint(0, 4)) for n in range(1, rng.randint(2, 20))] for d in range(60)}
    df = spark.createDataFrame([(d, *r) for d, rows in docs.items() for r in rows], "d long, n int, text string, lv int")
    got = {(r.d, r.n): r.level for r in folds.smooth_levels(df, "d", "n", "text", "lv").collect()}
    for d, rows in docs.items():
        last = {}
        for n, text, level in rows:
            head = (text or "").split(" ")[0].rstrip(".")
            path = head.split(".") if head[:1].isdigit() else []
            k = len(path)
            if level > 0 and k and (k == 1 or k not in last or k - 1 in last or last[k][:-1] == path[:-1]):
                last = {j: p for j, p in last.items() if j < k} | {k: path}
                level = 2 if k == 1 else min(k, 4)
            assert got[d, n] == level, (d, n)


@pytest.mark.parametrize(
    "raw, value",
    [
        ('```json\n{"a": 1, "b": [1, 2,],}\n```', {"a": 1, "b": [1, 2]}), ('{"a": {"b": "x', {"a": {"b": "x"}}), ("[1, 2", [1, 2]), ('say {"a": null; "x": "y\\"z"} and {"b": 2}', {"a": None, "x": 'y"z'}),
        ('// c\n{"a": /* z */ 1.5e2, "b": true}', {"a": 150.0, "b": True}), ('{"a": [1, {"b": 2}', {"a": [1, {"b": 2}]}), ('{"a": "x" "b": [true, false}', {"a": "x", "b": [True, False]}), ("no json", None), ("", None), (None, None),
        ('{"u": "http://x.y/z", "e": ""}', {"u": "http://x.y/z", "e": ""}),
    ],
)
def test_tolerant(raw, value):
    assert tolerant(raw) == value


def test_held_in_loses_no_pair(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab ", k=rng.choice([0, 3, 9, 40]))) for _ in range(60)]
    parts = ["".join(rng.choices("ab ", k=rng.choice([3, 4, 7, 8, 9]))) for _ in range(40)]
    long, short = (spark.createDataFrame(list(enumerate(x)), f"{k} long, {v} string") for x, k, v in ((texts, "i", "x"), (parts, "j", "q")))
    got = {(r.j, r.i) for r in T.held_in(short, "q", long, "x", 3).where(F.col("x").contains(F.col("q"))).collect()}
    assert got == {(j, i) for j, q in enumerate(parts) for i, x in enumerate(texts) if q in x}


def test_single_owner(spark):
    rows = [(1, 7, 0.5), (2, 7, 0.5), (3, 7, 0.4), (2, 8, 0.1), (4, 7, 0.2)]
    got = merging.single_owner(spark.createDataFrame(rows, "node long, item long, s double"), "node", "item", "s").collect()
    assert sorted((r.node, r.item) for r in got if r.item is not None) == [(1, 7), (2, 8)] and sorted(r.node for r in got if r.item is None) == [3, 4]


@pytest.mark.parametrize("name", ["c6_token_join", "c8_cover", "c20_quote_block", "m15_source_answers", "t4_best_anchor", "e9_single_owner", "b17_umbrella_guard", "l2_adjacency", "m3_candidates", "j2_dense_cosine", "retrieval_bm25_topk"])
def test_no_nested_loops(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan


def test_parts_travel_without_their_texts(spark):
    short = spark.createDataFrame([(1, "abcdefghi")], "j long, q string")
    long = spark.createDataFrame([(2, "xxabcdefghi")], "i long, x string")
    plan = T.held_in(short, "q", long, "x")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode")].splitlines()
    assert all("x#" not in line.split("Generate")[0] for line in above if "q_part" in line)
    made = next(line for line in plan.splitlines() if "Generate explode" in line)
    assert made.count("xxhash64") == 1 and "x#" not in made.rsplit("[", 1)[1]
