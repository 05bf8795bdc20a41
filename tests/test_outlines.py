"""Outlines from flat rows against nested dictionaries."""

import random

import pytest

from docquarry.operators import outlines as O

SCHEMA = "d int, n int, name string, quote string, level int, parent_name string, source_kind string"


def key(x):
    return "".join((x or "").lower().split())


def group(r):
    if key(r[5]) and key(r[5]) != "head":
        return r[5].strip()
    cells = [c.strip() for c in (r[3] or "").strip(" |").split("|")]
    if "|" not in (r[3] or "") or len(cells) < 3:
        return None
    cell = cells[1] if cells[0].isdigit() and len(cells) >= 4 else cells[0]
    return None if cell.isdigit() or key(cell) in ("", "head") else cell


def tree(rows):
    """(pos, number, name, kind) of one document."""
    named = [(r, r[2].strip() if (r[2] or "").strip() else (r[3] or "").strip()) for r in rows]
    groups = {}
    for r, name in named:
        g = group(r) if r[6] == "index_table" else None
        if g and name and key(name) != "head":
            box = groups.setdefault(key(g), (r[1], g, {}))
            if key(name):
                box[2].setdefault(key(name), (r[1], name))
    if len(groups) >= 2:
        out = []
        for i, (n, g, held) in enumerate((x for x in groups.values() if x[2]), 1):
            out.append((n, str(i), g, "group"))
            out += [(m, f"{i}.{j}", name, "row") for j, (m, name) in enumerate(held.values(), 1)]
        return sorted(out)
    at = {}
    for r, name in named:
        if key(name) and key(name) not in at:
            at[key(name)] = {"r": r, "name": name, "children": []}
    roots, stack = [], {}
    for k, node in at.items():
        level, wanted = max(node["r"][4] or 1, 1), key(node["r"][5])
        parent = at[wanted] if wanted and wanted != k and wanted in at else next((stack[j] for j in range(level - 1, 0, -1) if j in stack), None)
        (parent["children"] if parent else roots).append(node)
        level = level if parent else 1
        stack = {j: x for j, x in stack.items() if j < level} | {level: node}
    out = []

    def number(nodes, prefix):
        for i, node in enumerate(nodes, 1):
            out.append((node["r"][1], f"{prefix}{i}", node["name"], "row"))
            number(node["children"], f"{prefix}{i}.")

    number(roots, "")
    return sorted(out)


def test_outlines(spark):
    r = random.Random(6)
    docs = {}
    for d in range(40):
        # Parents are named by rows behind them, so no circle can arise.
        names = ["Top", *[f"{r.choice('ABCDEFGHIJ')} {r.choice('xX')}" for _ in range(r.choice([0, 5, 40]))]]
        docs[d] = [(d, i, r.choice([x, x, x, x, None, " "]) if i else x, r.choice([None, x, f"| {i} | G{i % 3} | {x} | y |", f"|{r.choice(['Head', 'g 1', '7'])}|b|c|"]), r.choice([None, 0, 1, 2, 3, 6]), r.choice([None, "top ", "nowhere"]) if d % 2 else r.choice([None, " ", "g1", "HEAD", "G 2"]), "text" if d % 2 else r.choice(["index_table"] * 4 + [None])) for i, x in enumerate(names)]
    df = spark.createDataFrame([x for rows in docs.values() for x in rows] + [(None, 0, "x", None, 1, None, None)], SCHEMA).repartition(5)
    got = {}
    for g in O.outline(df, "d", "n", ("Head",)).collect():
        got.setdefault(g["d"], []).append((g["n"], g["number"], g["name"], g["kind"]))
        assert g["parent"] == (g["number"].rpartition(".")[0] or None)
    assert {d: sorted(x) for d, x in got.items()} == {d: tree(rows) for d, rows in docs.items()}


def test_circles_and_empty_tables(spark):
    rows = [(1, 0, "a", None, 1, "b", None), (1, 1, "b", None, 2, "a", None)]
    with pytest.raises(ValueError, match="circle"):
        O.outline(spark.createDataFrame(rows, SCHEMA), "d", "n").collect()
    assert O.outline(spark.createDataFrame([], SCHEMA), "d", "n").collect() == []
