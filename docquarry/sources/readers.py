"""Sources: lines, outlines, HTML and DOCX blocks, JSON configurations, chosen by file name."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.runtime import ship

BLOCKS = "path string, pos int, kind string, text string, level int"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per line: key, pos from 0, line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


#: Full stops inside numbers, and what may stand between a number and a name.
DOTS = ".．"
MARKS = ("、", ")", ":", "：")


def outline(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pasted outlines: key, pos, number, name, parent_pos.

    A text counts as an outline with two numbered lines or more, and three in five of its non-empty lines numbered. A line's
    parent is the last earlier one that bears its number without the last part; without one it is a root.
    """
    rows = lines(docs, key, text).withColumn("line", F.trim(F.regexp_replace("line", r"\s", " "))).where(F.col("line") != "")
    lead = F.regexp_extract("line", f"^[0-9{DOTS}]+", 0)  # digits and dots, of which those at the end only part the number from the name
    number = F.rtrim(F.translate(lead, DOTS, "." * len(DOTS)), F.lit("."))
    rest = F.ltrim(F.substr("line", F.length(lead) + 1))
    name = F.when(F.left(rest, F.lit(1)).isin(*MARKS), F.substr(rest, F.lit(2))).otherwise(rest)
    rows = rows.withColumn("number", F.when(F.exists(F.split(number, "[.]"), lambda p: p == ""), "").otherwise(number)).withColumn("name", F.rtrim(F.trim(name), F.lit(":： ")))
    hit = (F.col("number") != "") & (F.col("name") != "")
    whole = Window.partitionBy(key)
    rows = rows.withColumn("q_hits", F.count_if(hit).over(whole)).withColumn("q_lines", F.count(F.lit(1)).over(whole))
    rows = rows.where(hit & (F.col("q_hits") >= 2) & (F.col("q_hits") >= 0.6 * F.col("q_lines"))).select(key, "pos", "number", "name")
    rows = rows.withColumn("number", F.array_join(F.transform(F.split("number", "[.]"), lambda p: p.cast("decimal(30,0)").cast("string")), "."))
    up = rows.select(key, F.col("number").alias("q_up"), F.col("pos").alias("q_pos"))
    cut = rows.withColumn("q_up", F.regexp_replace("number", r"\.?[0-9]+$", ""))
    found = cut.join(up, [key, "q_up"], "left").groupBy(key, "pos", "number", "name").agg(F.max(F.when(F.col("q_pos") < F.col("pos"), F.col("q_pos"))).alias("parent_pos"))
    return found


def docx_rows(data: bytes) -> list[tuple[str, str, int]]:
    """(kind, text, heading level) of a DOCX body in order: paragraphs that aren't blank, and tables as piped lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    read = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p" and (text := read(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            digit = name[-1:] if name.lower().startswith("heading") else ""
            out.append(("paragraph", text, int(digit) if digit.isdigit() else 0))
        elif node.tag == f"{_W}tbl":
            rows = [" | ".join(read(c) for c in r.iter(f"{_W}tc")) for r in node.iter(f"{_W}tr")]
            out.append(("table", "\n".join(f"| {r} |" for r in rows), 0))
    return out


def docx_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of DOCX files, read by Spark's binary reader; broken files give a single block of kind error."""
    ship(spark)

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    rows = docx_rows(bytes(data))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows = [("error", type(e).__name__, 0)]
                yield pd.DataFrame([(p, i, *r) for i, r in enumerate(rows)], columns=["path", "pos", "kind", "text", "level"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(parse, BLOCKS)


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as blocks."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return lines(rows, "path").where(F.trim("line") != "").select("path", "pos", F.lit("paragraph").alias("kind"), F.trim("line").alias("text"), F.lit(0).alias("level"))


def config(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> dict[str, str]:
    """A JSON object of settings over its defaults, one level deep: bounded by the file that a person wrote."""
    row = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path).first()
    return {**(defaults or {}), **({k: v for k, v in row.asDict().items() if v is not None} if row else {})}


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"docx": docx_blocks, "txt": text_blocks, "md": text_blocks}


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of one file or glob, by the reader of its suffix."""
    suffix = path.rpartition(".")[2].lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for .{suffix}")
    return READERS[suffix](spark, path)
