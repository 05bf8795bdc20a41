"""Trees of any depth, and trees that are none."""

import pytest

from docquarry.operators import trees

NODE = "id string, parent_id string, pos long, name string"


def test_deep_and_wide(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None, i, f"n{i}") for i in range(700)]
    wide = [("r", None, 0, "root"), *((f"w{i}", "r", i, f"leaf {i}") for i in range(500)), ("z", "w3", 0, None)]
    got = {r.id: r for r in trees.flatten(spark.createDataFrame(chain + wide, NODE)).collect()}
    assert len(got) == 700 + 502
    assert got["c699"].level == 700 and got["c699"].path == " / ".join(f"n{i}" for i in range(700)) and got["c699"].ids == [f"c{i}" for i in range(700)]
    assert got["w7"].path == "root / leaf 7" and got["w7"].is_leaf and not got["w3"].is_leaf and got["z"].path == "root / leaf 3" and got["z"].level == 3


def test_lost_parents_and_circles(spark):
    df = spark.createDataFrame([("a", None, 0, "A"), ("b", "gone", 0, "B"), ("c", "b", 0, "C")], NODE)
    with pytest.raises(ValueError, match="no nodes"):
        trees.flatten(df)
    assert {r.id: (r.level, r.path) for r in trees.flatten(df, orphans="roots").collect()} == {"a": (1, "A"), "b": (1, "B"), "c": (2, "B / C")}
    circle = spark.createDataFrame([("a", "c", 0, "A"), ("b", "a", 0, "B"), ("c", "b", 0, "C"), ("r", None, 0, "R")], NODE)
    with pytest.raises(ValueError, match="circle"):
        trees.flatten(circle)
    assert trees.flatten(df.limit(0)).count() == 0


def test_subtrees(spark):
    df = spark.createDataFrame([("a", None, 0, "A"), ("b", "a", 0, "B"), ("c", "b", 0, "C"), ("d", None, 1, "D")], NODE)
    assert sorted(r.id for r in trees.without_subtree(df, spark.createDataFrame([("b",)], "id string")).collect()) == ["a", "d"]
