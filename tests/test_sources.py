import zipfile

import pytest

from docquarry.functions import text as T
from docquarry.operators import merging, sections
from docquarry.sources import readers, sinks
from docquarry.streaming import events
from pyspark.sql import functions as F

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_docx(spark, tmp_path):
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>bo</w:t><w:t>dy</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    (tmp_path / "y.docx").write_bytes(b"no zip")
    rows = readers.docx_blocks(spark, str(tmp_path)).collect()
    assert [(r.pos, r.kind, r.text, r.level) for r in rows if r.path.endswith("x.docx")] == [(0, "paragraph", "One", 1), (1, "paragraph", "body", 0), (2, "table", "| a | b |", 0)]
    assert [r.kind for r in rows if r.path.endswith("y.docx")] == ["error"]
    (tmp_path / "z.txt").write_text("a\n\n b ")
    assert [(r.pos, r.text) for r in readers.blocks(spark, f"{tmp_path}/z.txt").collect()] == [(0, "a"), (2, "b")]
    with pytest.raises(ValueError):
        readers.blocks(spark, "x.exe")


def test_outline(spark):
    df = spark.createDataFrame([(1, "1 A\n1.1 B\n2 C"), (2, "1 only\nprose here\nand more"), (3, "2.1 x\n2 y:\n2．1 z"), (4, None), (5, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.pos, r.number, r.name, r.parent_pos) for r in readers.outline(df).collect()) == [(1, 0, "1", "A", None), (1, 1, "1.1", "B", 0), (1, 2, "2", "C", None), (3, 0, "2.1", "x", None), (3, 1, "2", "y", None), (3, 2, "2.1", "z", 1)]


def stack(levels):
    """Parent positions, chapter numbers and ends by a stack and counters."""
    out, tops, counts = [], [], {}
    for p, lv in enumerate(levels):
        if lv == 0:
            out.append((tops[-1][0] if tops else None, None, None))
            continue
        tops = [t for t in tops if t[1] < lv]
        counts = {k: v for k, v in counts.items() if k <= lv}
        for k in range(1, lv):
            counts.setdefault(k, 1)
        counts[lv] = counts.get(lv, 0) + 1
        end = next((q for q in range(p + 1, len(levels)) if 1 <= levels[q] <= lv), len(levels))
        out.append((tops[-1][0] if tops else None, ".".join(str(counts[k]) for k in range(1, lv + 1)), end))
        tops.append((p, lv))
    return out


def test_sections_against_a_stack(spark):
    import random

    rng = random.Random(2)
    docs = [[rng.randrange(5) for _ in range(rng.randrange(1, 25))] for _ in range(120)] + [[1, 3], [1, 2, 3, 2, 1, 3], [1, 3, 2]]
    df = spark.createDataFrame([(i, p, lv) for i, d in enumerate(docs) for p, lv in enumerate(d)], "doc_id long, pos long, level int")
    got = {(r.doc_id, r.pos): (r.parent_pos, r.chapter_id, r.end_pos) for r in sections.ends(sections.chapter_ids(sections.parents(df))).collect()}
    assert got == {(i, p): x for i, d in enumerate(docs) for p, x in enumerate(stack(d))}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert sorted(one(T.grams(F.lit("abcd")))) == ["ab", "abc", "abcd", "bc", "bcd", "cd"]
    assert one(T.grams(F.lit(""))) == [] and one(T.grams(F.lit("a"))) == ["a"]
    assert one(T.collapse_doubled(F.lit("AABBCC"))) == "ABC" and one(T.collapse_doubled(F.lit("AABB"))) == "AABB"
    assert one(T.compact(F.lit("a\u3000 b\n"))) == "ab"
    assert one(T.clean_title(F.lit("1.2 Scope of work ..... 17"))) == "Scope of work"
    assert [one(T.heading_level(F.lit(t))) for t in ("Chapter 1 x", "1 x", "1.2 x", "1.2.3.4.5 x", "(3) x", "x", "9" * 81)] == [1, 2, 2, 4, 3, 0, 0]
    assert one(T.reference_number(F.lit("see Annex 07"))) == 7 and one(T.reference_number(F.lit("none"))) is None
    assert one(T.outline_key(F.lit(" Scope [required]： "))) == "scope"
    assert one(T.is_placeholder(F.lit(None).cast("string"))) and not one(T.is_placeholder(F.lit("done")))


def test_merging(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, pos int, v string")
    assert sorted(tuple(r) for r in merging.last_wins(rows, ["k"], "pos").collect()) == [("a", 1, "z"), ("b", 2, "y")]
    other = spark.createDataFrame([("b", 9, "q"), ("c", 9, "q")], rows.schema)
    assert sorted(r.k for r in merging.union_left_wins(rows, other, ["k"]).collect()) == ["a", "a", "b", "c"]
    old = spark.createDataFrame([("a", " "), ("b", "old")], "k string, v string")
    assert sorted(tuple(r) for r in merging.existing_wins(rows.where("pos > 1").select("k", "v"), old, "k", "v").collect()) == [("a", "z"), ("b", "old")]


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    source.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]).repartition(3).write.parquet(str(tmp_path / "in"))
    for name, op in (("w", lambda e: events.windowed(e, late="100 days")), ("s", lambda e: events.sessions(e, late="100 days")), ("d", lambda e: events.deduplicated(e, "100 days").select("event_id"))):
        q = op(events.read(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName(f"out_{name}").outputMode("append" if name == "d" else "complete" if name == "w" else "append")
        q.option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start().awaitTermination(120)
        if name != "s":  # sessions are given out only once the watermark has passed them
            assert spark.table(f"out_{name}").count() == op(spark.read.parquet(str(tmp_path / "in"))).count()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.replace_partitions(rows, str(tmp_path / "t"), ["k"])
    sinks.replace_partitions(spark.createDataFrame([(2, "c")], rows.schema), str(tmp_path / "t"), ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c")]
    sinks.json_lines(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
