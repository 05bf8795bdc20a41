"""Shared state from updates: a stream over shuffled files with repeats ends as the table does, and as a loop over the updates."""

import random

from docquarry.streaming import events, reducers

SCHEMA = "k string, at int, id int, title string, n int, warnings array<string>"


def drawn(n, seed=5):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "c", None]), r.choice([None, 1, 2, 3, 4]), i, r.choice([None, "x", "y", ""]), r.choice([None, 1, 2]), r.choice([None, [], ["w"], [f"w{i}", "again"]])) for i in range(n)]
    return rows + r.sample(rows, n // 3)


def looped(rows):
    out = {}
    unique = {(x[0], x[1], x[2]): x for x in rows}.values()
    for k, _, _, title, n, warnings in sorted(unique, key=lambda x: (-1 if x[1] is None else x[1], x[2])):
        s = out.setdefault(k, {"title": None, "n": None, "warnings": []})
        s["title"] = s["title"] if title is None else title
        s["n"] = s["n"] if n is None else n
        s["warnings"] += warnings or []
    return out


def state(rows):
    return {r["k"]: {c: r[c] for c in ("title", "n", "warnings")} for r in rows}


def reduce(df):
    return reducers.reduced(df, "k", "at", "id", ("title", "n"), ("warnings",))


def test_table_equals_a_loop(spark):
    rows = drawn(200)
    assert state(reduce(spark.createDataFrame(rows, SCHEMA)).collect()) == looped(rows)
    assert reduce(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ties_take_the_greater_value(spark):
    rows = [("a", 1, 1, "x", None, ["p"]), ("a", 1, 1, "y", None, ["q"])]
    assert state(reduce(spark.createDataFrame(rows[::-1], SCHEMA)).collect()) == {"a": {"title": "y", "n": None, "warnings": ["p", "q"]}}


def test_stream_equals_table(spark, tmp_path):
    rows = drawn(120)
    random.Random(1).shuffle(rows)
    where = str(tmp_path / "in")
    for i in range(0, len(rows), 20):
        spark.createDataFrame(rows[i : i + 20], SCHEMA).coalesce(1).write.mode("append").parquet(where)
    seen, batches = {}, []

    def keep(batch, n):
        batches.append(n)
        seen.update(state(batch.collect()))

    stream = reduce(events.read(spark, where, SCHEMA, files_per_trigger=2))
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(batches) > 1 and seen == state(reduce(spark.read.schema(SCHEMA).parquet(where)).collect()) == looped(rows)
