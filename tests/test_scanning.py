"""Sections of office documents against the stack that they are defined by, and texts of ranges against cuts in Python."""

import random
import re

import pytest

from docquarry.operators import scanning as S

BLOCKS = "doc_id long, pos int, kind string, text string, style string, outline int, images int, graphics int"


def level_of(b, fallback):
    style = (b[4] or "").strip().lower()
    if style.startswith("toc") or "目录" in style:
        return 0
    m = re.search(r"(?:^|\s)heading\s*(\d+)\b", style) or re.search(r"标题\s*(\d+)", style)
    if m:
        return int(m[1]) if 1 <= int(m[1]) <= 9 else 0
    if b[5] is not None and 0 <= b[5] <= 8:
        return b[5] + 1
    m = fallback and re.match(r"(\d+(?:\.\d+)*)(?:[.、]\s*|\s+)", b[3])
    return min(m[1].count(".") + 1, 4) if m and len(b[3]) <= 80 else 0


def scanned(blocks):
    """One document, by a stack."""
    told = [b for b in blocks if b[2] == "paragraph" and b[3]]
    fallback = sum(level_of(b, False) > 0 for b in told) < 3
    stack, done, counters = [], [], {}
    for b in told:
        level = level_of(b, fallback)
        if not level or b[3] in ("目录", "目 录"):
            continue
        while stack and stack[-1]["level"] >= level:
            done.append({**stack.pop(), "end_block": b[1]})
        counters = {k: v for k, v in counters.items() if k <= level}
        counters[level] = counters.get(level, 0) + 1
        for k in range(1, level):
            counters.setdefault(k, 1)
        title = re.sub(r"^\d+(?:\.\d+)*[.、\s]+", "", b[3]).strip() or "未命名章节"
        path = f"{stack[-1]['full_path']}/{title}" if stack else title
        stack.append({"pos": b[1], "chapter_id": ".".join(str(counters[k]) for k in sorted(counters)), "title": title, "full_path": path, "level": level, "start_block": b[1] + 1})
    done += [{**s, "end_block": len(blocks)} for s in stack]
    for d in done:
        held = blocks[d["start_block"] - 1 : d["end_block"]]
        d.update(image_count=sum(b[6] or 0 for b in held), table_count=sum(b[2] == "table" for b in held), graphic_count=sum(b[7] or 0 for b in held))
    return sorted(done, key=lambda d: d["pos"])


def drawn(seed, n, styled):
    r = random.Random(seed)
    styles = ["Heading 1", "heading 2", "My Heading 3 x", "标题 4", "Heading 9", "Heading 12", "TOC Heading 1", "目录 1", "Normal"]
    texts = ["1. One", "1.2 Two", "1.2.3、Three", "1.2.3.4.5 Deep", "2.", "3abc", "目录", "body", "", "7 " + "x" * 90, "1 x/y"]
    return [(seed, i, r.choice(["paragraph"] * 5 + ["table"]), r.choice(texts), r.choice(styles) if r.random() < styled else r.choice([None, "Normal"]), r.choice([0, 3, 8, 9]) if r.random() < styled / 4 else None, r.choice([None, 0, 1, 2]), r.choice([None, 0, 1])) for i in range(n)]


def test_sections_equal_a_stack(spark):
    docs = [drawn(s, n, styled) for s, (n, styled) in enumerate([(60, 0.5), (60, 0.0), (60, 0.03), (1, 1.0), (200, 0.9), (40, 0.05), (40, 0.08), (300, 0.2)])]
    got = {}
    for r in S.section_scan(spark.createDataFrame([b for d in docs for b in d], BLOCKS).repartition(5)).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append({k: v for k, v in r.asDict().items() if k != "doc_id"})
    assert got == {s: want for s, d in enumerate(docs) if (want := scanned(d))}


@pytest.mark.parametrize("explicit, want", [(2, ["a", "b", "c"]), (3, ["a", "b", "d"])])
def test_numbered_lines_count_below_three_headings(spark, explicit, want):
    blocks = [(1, 0, "paragraph", "a", "Heading 1", None, 0, 0), (1, 1, "paragraph", "b", None, 1, 0, 0), (1, 2, "paragraph", "1.1 c", None, None, 0, 0), (1, 3, "paragraph", "d", "Heading 1" if explicit == 3 else None, None, 0, 0)]
    assert [r["title"] for r in S.section_scan(spark.createDataFrame(blocks, BLOCKS)).orderBy("pos").collect()] == want


def test_no_blocks_and_null_texts(spark):
    empty = spark.createDataFrame([], BLOCKS)
    assert S.section_scan(empty).collect() == []
    assert S.section_scan(spark.createDataFrame([(1, 0, "paragraph", None, "Heading 1", None, 1, 1)], BLOCKS)).collect() == []
    ranges = spark.createDataFrame([(1, 1, 1, None), (2, 1, 5, 9)], "id int, doc_id long, start_block int, end_block int")
    assert sorted(map(tuple, S.range_text(ranges, empty, "id").collect())) == [(1, ""), (2, "")]


def cut(blocks, start, end, most):
    parts, n = [], 0
    for t in blocks[max(start - 1, 0) : end]:
        if t:
            parts.append(t)
            n += len(t)
            if n >= most:
                break
    return "\n".join(parts).strip()[:most]


@pytest.mark.parametrize("most", [1, 7, 50, 6000])
def test_texts_of_ranges(spark, most):
    r = random.Random(most)
    docs = {d: ["x" * r.choice([0, 1, 3, 30]) + r.choice(["", "ü"]) for _ in range(r.choice([1, 20, 90]))] for d in range(6)}
    ranges = [(i, r.randrange(7), r.randrange(0, 95), r.randrange(0, 99)) for i in range(80)]
    blocks = spark.createDataFrame([(d, i, t or None) for d, ts in docs.items() for i, t in enumerate(ts)], "doc_id int, pos int, text string")
    got = dict(map(tuple, S.range_text(spark.createDataFrame(ranges, "id int, doc_id int, start_block int, end_block int"), blocks, "id", most=most).collect()))
    assert got == {i: cut(docs.get(d, []), a, b, most) for i, d, a, b in ranges}


def test_cut_texts_keep_what_the_cut_ends_with(spark):
    blocks = spark.createDataFrame([(1, 0, " abc  def "), (1, 1, "\u00a0x\u3000"), (1, 2, "y" + " " * 9 + "z")], "doc_id int, pos int, text string")
    ranges = spark.createDataFrame([(i, 1, a, b) for i, a, b in [(1, 1, 1), (2, 2, 3), (3, 2, 2)]], "id int, doc_id int, start_block int, end_block int")
    assert sorted(map(tuple, S.range_text(ranges, blocks, "id", most=5).collect())) == [(1, "abc  "), (2, "x\ny  "), (3, "x")]


def test_assembled_texts(spark):
    tree = [("r", None, 1, "R", "own"), ("b", "r", 2, "B", None), ("a", "r", 1, "A", "a text"), ("aa", "a", 1, "AA", "aa text"), ("ab", "a", 2, "", "untitled"), ("deep", "aa", 1, "D", "never in r"), ("x", "gone", 1, "X", ""), ("a2", "r", 1, None, None)]
    got = dict(map(tuple, S.assembled(spark.createDataFrame(tree, "id string, parent string, ord int, title string, content string"), "id", "parent", "ord").collect()))
    assert got["r"] == "own\n\n## A\na text\n\n### AA\naa text\nuntitled\n\n## B"
    assert got["a"] == "a text\n\n## AA\naa text\n\n### D\nnever in r\nuntitled"
    assert got["x"] == "" and got["b"] == "" and "gone" not in got
