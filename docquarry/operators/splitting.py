"""Rows that list several materials in one quote, split into child rows that the quote holds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import compact
from docquarry.runtime import ship

#: Lengths of quotes, without white space, that may be split; edges that a child loses; kinds of copies that a child's core leaves out.
SHORTEST, LONGEST, EDGES = 18, 360, " ：:，,。；;、"
COPIES = "(?:复印件|原件|截图|扫描件|证明文件|证明材料|材料|文件)$"
#: A picture of a page counts as held if its page is, and the quote speaks of pictures or pages.
PICTURE, PAGES = "截图", ("截图", "页面", "PDF")
OPENING, CLOSING = "([{（【《", ")]}）】》"


@dataclass(frozen=True)
class Words:
    """What makes a quote a list. The separators are this library's own, as its splitting is by rule."""

    #: Fixed values.
    markers: tuple[str, ...] = ("、", "/", "及", "和", "分别提供", "如下", "下列", "包括")
    terms: tuple[str, ...] = ("营业执照", "登记证书", "资格证明", "资质证明", "许可证", "截图", "证明文件", "证书", "报价函", "应答函", "承诺函", "声明", "业绩", "人员资质", "荣誉", "认证", "清单")
    open_lists: tuple[str, ...] = ("应包括但不限于以下内容", "包括但不限于以下内容", "参见本采购文件提供的格式")
    separators: tuple[str, ...] = ("、", "/", "，", ",", "；", ";", "及", "和")
    #: What stands before the list, up to and including the first match.
    opener: str = "(?:包括|如下|下列)[^、，,；;:：]*[:：]|包括|如下|下列|[:：]"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(w) for w in words)) if words else F.lit(False)


def needs_split(words: Words) -> Column:
    """Whether a row (name, quote, parent_name, source_kind) lists materials: not a child, not from an index table, of middle length, with a marker and a material."""
    quote = F.coalesce(F.nullif("quote", F.lit("")), "name", F.lit(""))
    size = F.length(compact(quote))
    free = (F.coalesce("parent_name", F.lit("")) == "") & (F.coalesce("source_kind", F.lit("")) != "index_table")
    closed = ~_any(compact(quote), tuple("".join(w.split()) for w in words.open_lists))
    cheap = free & (F.length(quote) >= SHORTEST) & _any(quote, words.markers) & _any(F.concat_ws(" ", quote, "name"), words.terms)
    return cheap & size.between(SHORTEST, LONGEST) & closed


def pieces(text: str, separators: re.Pattern) -> list[str]:
    """text cut at separators outside brackets. A closing bracket without an opening one is a letter; one that stays open reaches to the end."""
    out, start, depth = [], 0, 0
    for m in separators.finditer(text):
        if m[0] in OPENING:
            depth += 1
        elif m[0] in CLOSING:
            depth = max(depth - 1, 0)
        elif not depth:
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


def proposals(rows: DataFrame, key: str, pos: str, words: Words = Words()) -> DataFrame:
    """key, pos, n, child: the pieces of the quotes that need a split and name a material; quotes are whole, so texts of any length may stand beside them."""
    ship(rows.sparkSession)
    marks = re.compile("|".join([f"[{re.escape(OPENING + CLOSING)}]", *map(re.escape, words.separators)]))

    @F.pandas_udf("array<string>")
    def split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda text: pieces(text, marks))

    quote = F.coalesce(F.nullif("quote", F.lit("")), "name")
    listed = rows.where(needs_split(words)).select(key, pos, split(F.regexp_replace(quote, f"(?s)^.*?(?:{words.opener})", "")).alias("q_pieces"))
    return listed.select(key, pos, F.posexplode("q_pieces").alias("n", "q_child")).select(key, pos, "n", F.trim("q_child").alias("child")).where(_any(F.col("child"), words.terms))


def supported(child: Column, quote: Column) -> Column:
    """Whether the quote holds the child: its letters, or its core without the kind of copy (4 letters or more), or the page that it is a picture of."""
    c, q = compact(child), compact(quote)
    core, page = F.regexp_replace(c, COPIES, ""), F.regexp_replace(c, f"{PICTURE}$", "")
    pictured = c.endswith(PICTURE) & (F.length(page) >= 4) & q.contains(page) & _any(q, PAGES)
    return F.coalesce((F.length(c) >= 2) & (q.contains(c) | ((F.length(core) >= 4) & q.contains(core)) | pictured), F.lit(False))


def refined(rows: DataFrame, proposed: DataFrame, key: str, pos: str) -> DataFrame:
    """rows (key, pos, name, quote, parent_name, level), each followed by its children among the proposed (key, pos, n, child), wherever those come
    from: place numbers all rows of a key from 1, inline marks children.

    A child stays if the row's quote holds it and if it is neither the row's own name nor an earlier child, white space aside; it has the row's quote, its name
    as parent_name, and a level more. key and pos together must be unique; rows without children stay as they are.
    """
    held = proposed.join(rows.select(key, pos, "name", F.coalesce(F.nullif("quote", F.lit("")), "name").alias("quote"), "level"), [key, pos]).where(supported(F.col("child"), F.col("quote")))
    bare = held.withColumn("child", F.btrim("child", F.lit(EDGES))).withColumn("q_key", compact(F.col("child")))
    fresh = bare.where((F.col("q_key") != "") & (F.col("q_key") != compact(F.coalesce("name", F.lit("")))))
    first = fresh.groupBy(key, pos, "q_key").agg(F.min(F.struct("n", "child", "name", "quote", "level")).alias("q"))
    children = first.select(key, pos, F.col("q.n").alias("n"), F.col("q.child").alias("name"), "q.quote", F.trim("q.name").alias("parent_name"), (F.coalesce("q.level", F.lit(1)) + 1).alias("level"), F.lit(True).alias("inline"))
    own = rows.select(key, pos, F.lit(-1).alias("n"), "name", "quote", "parent_name", "level", F.lit(False).alias("inline"))
    return own.unionByName(children).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(pos, "n"))).drop("n")
