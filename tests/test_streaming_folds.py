"""Folds that read a document's rows once, against loops; long documents, null documents, sizes and empty tables."""

import random

import pytest

from docquarry.operators import folds


def grouped(rows, n=1):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r)[1:] if n > 1 else r[1])
    return out


@pytest.fixture(scope="module")
def sized():
    r = random.Random(8)
    docs = {d: [(i, r.choice([None, 0, 1, 5, 9, 30])) for i in range(n)] for d, n in ((1, 30), (2, 1), (3, 9000), (None, 25))}
    return docs, [(d, i, s) for d, x in docs.items() for i, s in x]


def test_batches(spark, sized):
    docs, rows = sized
    random.Random(1).shuffle(rows)
    got = grouped(folds.batched(spark.createDataFrame(rows, "d int, n int, s int").repartition(7), "d", "n", "s", 20).collect(), 2)
    for d, x in docs.items():
        want, size, batch = [], 0, 0
        for i, s in x:
            if size and size + (s or 0) > 20:
                size, batch = 0, batch + 1
            size += s or 0
            want.append((i, batch))
        assert sorted(got[d]) == want
    assert folds.batched(spark.createDataFrame([], "d int, n int, s int"), "d", "n", "s", 20).collect() == []


def test_budgets(spark, sized):
    docs, rows = sized
    df = spark.createDataFrame(rows, "d int, n int, s int").repartition(7)
    got = grouped(folds.within_budget(df, "d", ["s", "n"], "n", "s", 40).collect())
    for d, x in docs.items():
        want, left = [], None
        for s, i in sorted(((s if s is not None else -1), i) for i, s in x):
            s = max(s, 0)
            if left is None or s <= left:
                left = (40 if left is None else left) - s
                want.append(i)
        assert sorted(got[d]) == sorted(want)
    assert folds.within_budget(df.limit(0), "d", ["s", "n"], "n", "s", 40).collect() == []


def test_repeats(spark):
    texts = ["Chapter", "Chapter", "Chapter one", "ter one", "one", None, "Chapter one", "", "", "x"]
    df = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(texts)] + [(None, 0, "x"), (None, 1, "x")], "d int, pos long, t string")
    got = {d: sorted(x) for d, x in grouped(folds.unrepeated(df, "d", "pos", "t").collect()).items()}
    assert got == {1: [0, 2, 4, 6, 7, 9], 2: [0, 2, 4, 6, 7, 9], None: [0]}


def test_levels_of_any_depth(spark):
    rows = [(1, 0, "1.1.1.1.1.1.1.1 deep", 1), (1, 1, "1.1.1.1.1.1.1.3 deep", 1), (1, 2, "2.2.2.2.2.2.2.2 other", 1), (1, 3, "7 x", None), (1, 4, "7 x", 0)]
    got = folds.smooth_levels(spark.createDataFrame(rows, "d int, n int, t string, lv int"), "d", "n", "t", "lv").orderBy("n").collect()
    assert [g["level"] for g in got] == [4, 4, 1, None, 0]


def test_rows_stay_where_they_are_sorted(spark, sized):
    plan = folds.batched(spark.createDataFrame(sized[1], "d int, n int, s int"), "d", "n", "s", 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_list" not in plan
