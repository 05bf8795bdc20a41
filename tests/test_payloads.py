"""Payloads: walks of any depth, items of any shape."""

import json

import pytest
from pyspark.sql import functions as F

from docquarry.operators import payloads

RULES = [("files", True, True, "normal"), ("dates", False, True, "low")]


def parsed(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", F.try_parse_json("t").alias("v"))


def leaves(value, path="$"):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in leaves(v, f"{path}.{k}")]
    if isinstance(value, list):
        return [x for n, v in enumerate(value) for x in leaves(v, f"{path}[{n}]")]
    return [path]


def test_walk_reaches_every_depth(spark):
    deep = 1
    for n in range(40):
        deep = [deep] if n % 2 else {"k": deep, "e": {}, "n": None}
    texts = [json.dumps(deep), "[]", "{}", "null", '"x"', "7", None, "broken {", '{"a": [1, [2, {"b": true}], null], "c": ""}']
    got = payloads.walk(parsed(spark, *texts), "v").select("i", "path", "kind").collect()
    want = sorted((i, p) for i, t in enumerate(texts) if t and t != "broken {" for p in leaves(json.loads(t)))
    assert sorted((r.i, r.path) for r in got) == want
    assert {r.kind for r in got} == {"scalar", "null"}
    held = payloads.walk(parsed(spark, texts[-1]), "v", follow=F.col("path") != "$.a").select("path", "kind").collect()
    assert sorted(map(tuple, held)) == [("$.a", "array"), ("$.c", "scalar")]


def test_walk_stores_nothing_and_counts_brackets_outside_strings(spark, tmp_path):
    texts = ['{"a]}[{": "\\"[[\\\\", "b": [[{"c": "}"}]]}', "[[]]", "3", '"[[["', None, '{"x": [], "y": {}}', '["\\\\", [1]]']
    rows = parsed(spark, *texts)
    assert [r[0] for r in rows.orderBy("i").select(payloads.depth(F.col("v"))).collect()] == [4, 2, 0, 0, 0, 2, 2]
    got = payloads.walk(rows, "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 4 and "checkpoint" not in plan and "Exchange" not in plan, plan  # a checkpoint a level before
    assert sorted((r.i, r.path) for r in got.collect()) == sorted((i, p) for i, t in enumerate(texts) if t for p in leaves(json.loads(t)))


@pytest.mark.parametrize(
    ("files", "want"),
    [
        ('["a", "", null, " "]', [("a", "a", True, True, "normal")]),
        ('"single"', [("single", "single", True, True, "normal")]),
        ("5", [("5", "5", True, True, "normal")]),
        ("true", [("true", "true", True, True, "normal")]),
        ('{"name": "n", "mandatory": "No", "required": false, "severity": "Fatal"}', [("n", "n", False, False, "fatal")]),
        ('[[["x"]], ["y", {"text": "z", "quote": "said"}]]', [("x", "x", True, True, "normal"), ("y", "y", True, True, "normal"), ("z", "said", True, True, "normal")]),
        ('{"value": ["list"], "name": null, "text": "t", "quote": ""}', [("t", "t", True, True, "normal")]),
        ('{"value": "v", "mandatory": [false], "required": "perhaps", "severity": {}}', [("v", "v", True, True, "normal")]),
        ('{"other": 1}', []), ("[]", []), ("null", []), ("[{}, [[]]]", []),
    ],
)
def test_items(spark, files, want):
    df = spark.createDataFrame([(1, '{"files": ' + files + ', "dates": "d", "unknown": ["u"]}')], "i long, p string")
    rows = sorted(map(tuple, payloads.normalised(df, "i", "p", RULES).collect()))
    assert [(r[1], r[2]) for r in rows] == [("dates", 0), *(("files", n) for n in range(len(want)))]
    assert [r[3:] for r in rows if r[1] == "files"] == want and rows[0][3:] == ("d", "d", False, True, "low")


def test_odd_payloads(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "[1]"), (4, "{"), (5, '{"files": ["' + "x" * 100_000 + '"]}'), (5, '{"dates": 1}'), (None, '{"dates": 2}')], "i long, p string")
    got = payloads.normalised(df, "i", "p", RULES).collect()
    assert sorted(((r.i, r.list, len(r.atom)) for r in got), key=str) == sorted([(5, "files", 100_000), (5, "dates", 1), (None, "dates", 1)], key=str)
    assert payloads.normalised(df.limit(0), "i", "p", RULES).count() == 0
