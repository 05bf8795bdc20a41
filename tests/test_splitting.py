"""Lists of materials, split by rule or by proposals from elsewhere, against loops over their letters."""

import random
import re

from docquarry.operators import splitting as P

ROWS = "doc int, pos int, name string, quote string, parent_name string, source_kind string, level int"


def by_letters(text, separators):
    out, depth, piece = [], 0, ""
    i = 0
    while i < len(text):
        sep = next((s for s in separators if text.startswith(s, i)), None)
        if text[i] in P.OPENING:
            depth += 1
        elif text[i] in P.CLOSING:
            depth = max(depth - 1, 0)
        elif sep and not depth:
            out.append(piece)
            piece = ""
            i += len(sep)
            continue
        piece += text[i]
        i += 1
    return [*out, piece]


def test_pieces():
    r = random.Random(3)
    seps = ("、", " and ", ",")
    marks = re.compile("|".join([f"[{re.escape(P.OPENING + P.CLOSING)}]", *map(re.escape, seps)]))
    for _ in range(500):
        text = "".join(r.choice(["a", "b ", "、", ",", " and ", "(", ")", "（", "）", "[", "]"]) for _ in range(r.randrange(0, 30)))
        assert P.pieces(text, marks) == by_letters(text, seps)
    assert P.pieces("x" * 300_000 + "," + "(" * 10_000 + ",", marks) == ["x" * 300_000, "(" * 10_000 + ","]


def test_rows_and_children(spark):
    listed = "投标人须提供下列材料：营业执照（正本、副本）、资质证书 复印件、荣誉证书及营业执照（正本、副本）"
    rows = [
        (1, 0, "资质", listed, None, "text", 2),
        (1, 1, "荣誉证书", listed, "", None, None),
        (1, 2, "child", listed, "above", "text", 1),
        (1, 3, "table", listed, None, "index_table", 1),
        (1, 4, "short", "证书、声明", None, None, 1),
        (1, 5, "open", "应包括但不限于以下内容：营业执照、资质证书、荣誉证书、声明、承诺函", None, None, 1),
        (1, 6, "long", "证书、" * 200, None, None, 1),
        (2, 0, "报价函及应答函和其他需要提供的全部响应文件", None, None, None, 1),
        (2, 1, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ROWS)
    got = P.refined(df, P.proposals(df, "doc", "pos"), "doc", "pos").orderBy("doc", "place").collect()
    assert [(g["place"], g["name"], g["parent_name"], g["level"]) for g in got if g["doc"] == 1 and g["pos"] == 0] == [
        (1, "资质", None, 2), (2, "营业执照（正本、副本）", "资质", 3), (3, "资质证书 复印件", "资质", 3), (4, "荣誉证书", "资质", 3),
    ]
    assert [(g["place"], g["name"], g["inline"]) for g in got if g["doc"] == 1 and g["pos"] == 1] == [(5, "荣誉证书", False), (6, "营业执照（正本、副本）", True), (7, "资质证书 复印件", True)]
    assert [g["pos"] for g in got if g["doc"] == 1 and g["pos"] > 1] == [2, 3, 4, 5, 6]
    assert [g["name"] for g in got if g["doc"] == 2] == ["报价函及应答函和其他需要提供的全部响应文件", "报价函", "应答函", None]
    none = df.limit(0)
    assert P.refined(none, P.proposals(none, "doc", "pos"), "doc", "pos").collect() == []


def test_only_what_the_quote_holds(spark):
    row = spark.createDataFrame([(1, 0, "row", "首页页面及营业执照、税务登记", None, None, 1)], ROWS)
    said = ["营业执照扫描件", "营业 执照", "：税务登记，", "社保", "执", "首页页面截图", "他页页面截图", None, ""]
    proposed = spark.createDataFrame([(1, 0, i, c) for i, c in enumerate(said)], "doc int, pos int, n int, child string")
    got = P.refined(row, proposed, "doc", "pos").orderBy("place").collect()
    assert [g["name"] for g in got] == ["row", "营业执照扫描件", "营业 执照", "首页页面截图"]
