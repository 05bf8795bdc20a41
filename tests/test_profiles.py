"""Cosines of all pairs against a count of common parts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry import catalog
from docquarry.operators import profiles

COUNTS = "k long, g int, part string, n long"


@pytest.mark.parametrize("block", [1024, 5])
def test_cosines_equal_common_parts(spark, monkeypatch, block):
    monkeypatch.setattr(profiles, "BLOCK", block)
    r = random.Random(block)
    held = defaultdict(Counter)
    for k in range(60):
        for g in {k % 2, r.choice([k % 2, 2]) if k % 5 == 0 else k % 2}:  # some keys are in two groups
            for _ in range(r.randrange(1, 7)):
                held[k, g][r.choice("abcdefghijklmnop")] += 1
    rows = [(k, g, p, n) for (k, g), c in held.items() for p, n in c.items()] + [(None, 0, "a", 1), (99, None, "a", 1), (98, 1, None, 3)]
    got = {(x.k, x.other): x.cosine for x in profiles.cosines(spark.createDataFrame(rows, COUNTS).repartition(3), "k", "g", "part", "n", "other").collect()}
    norm = {k: math.sqrt(sum(n * n for (i, _), c in held.items() if i == k for n in c.values())) for k in range(60)}
    dots = Counter()
    for (a, g), c in held.items():
        for (b, h), d in held.items():
            if a < b and g == h and (dot := sum(n * d[p] for p, n in c.items())):
                dots[a, b] += dot
    assert got == pytest.approx({(a, b): dot / norm[a] / norm[b] for (a, b), dot in dots.items()}, abs=6e-7) and len(got) > 200


def test_rounding_is_that_of_round(spark):
    x = [k / 128 for k in range(129)] + [1.0000005, 0.1234565, 0.1234564999, 2 / 3, 1e-9, 0.0000005] + [random.Random(1).random() for _ in range(2000)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert profiles.rounded(np.array(x)).tolist() == want


def test_short_names_have_no_pairs_of_characters(spark, tmp_path):
    names = [(1, 0, "a"), (2, 0, "A"), (3, 0, ""), (4, 0, None), (5, 0, "ab"), (6, 0, "xab"), (7, 1, "ab"), (8, None, "ab")]
    spark.createDataFrame(names, "s_suppkey int, s_nationkey int, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalog.QUERIES["j5_bigram_cosine"](spark, str(tmp_path))
    assert got.schema["s_suppkey"].dataType.simpleString() == "int" and sorted(map(tuple, got.collect())) == [(5, 6, 0.707107)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan  # a row for each common pair of characters before
