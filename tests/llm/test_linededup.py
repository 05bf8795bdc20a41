import hashlib
import random
from collections import defaultdict

import pytest

from docquarry import runtime
from docquarry.llm import linededup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute(rows):
    held = defaultdict(list)
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            held[k].append(-(1 << 63) if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        mine = -(1 << 63) if i is None else i
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != mine)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, **options):
    return sorted(map(tuple, linededup.line_digests(df, **options).collect()), key=str)


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(5)
    lines = [f"A line of some length, number {i}" for i in range(30)] + ["short", "", " \t", "Ünïcödé line ÀÉ with enough letters", "\x85 is no blank at an end of a line \x85", "exactly 20 letters :"]
    rows = []
    for i in range(120):
        text = "\n".join(rng.choice(["", "  ", "\t"]) + (rng.choice(lines).upper() if rng.random() < 0.3 else rng.choice(lines)) + rng.choice(["", " ", "\r"]) for _ in range(rng.randrange(12)))
        rows.append((rng.choice([i, i, i % 7, None]), text if i % 11 else None))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_brute_force(drawn, small, odd, empty):
    for df in (drawn, small, odd, odd.union(odd).union(odd)):
        assert got(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert got(empty) == []


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (2, 2), (7, 2), (9, 3)])
def test_any_batches_agree(drawn, batches, fanout):
    assert got(drawn, batches=batches, fanout=fanout) == brute([(r.doc_id, r.text) for r in drawn.collect()])


def test_without_broadcast(drawn, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", -1)
    assert got(drawn) == brute([(r.doc_id, r.text) for r in drawn.collect()])


def test_runs_are_levelled_and_sorted(spark):
    index = linededup.LineRuns(spark, fanout=2)
    try:
        for batch in range(6):
            rows = [(k, -k, 1, 100 - batch) for k in range(batch, batch + 5)]
            index.add(spark.createDataFrame(rows, "h1 long, h2 long, docs long, holder long").repartition(index.buckets, "h1", "h2"))
        assert [len(level) for level in index.levels] == [0, 1, 1]
        merged = {r.h1: (r.docs, r.holder) for r in index.merged(index.live()).collect()}
        assert merged == {k: (min(k, 5) - max(0, k - 4) + 1, 100 - max(0, k - 4)) for k in range(10)}
        plan = spark.table(index.live()[0]).join(spark.table(index.live()[1]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_rows_keep_their_columns(spark, odd):
    df = odd.selectExpr("*", "1 AS kept", "2 AS doc", "3 AS q_text", "4 AS h1")
    out = linededup.dedup_lines(df)
    assert out.columns == ["row", "kept", "n_lines", "n_dropped"]
    assert sorted(map(str, out.select("row.*").collect())) == sorted(map(str, df.collect()))
