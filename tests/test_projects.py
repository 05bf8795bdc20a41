"""Projects and templates in folders of JSON files."""

import json
import os

import pytest

from docquarry.sources import projects as P


def rows(df):
    return [r.asDict() for r in df.collect()]


def nodes(x):
    return sum(1 + nodes(n.get("children")) for n in x if isinstance(n, dict)) if isinstance(x, list) else 0


@pytest.fixture
def folder(tmp_path):
    deep = [{"name": "a", "children": [{"children": [{}, "no node", {"children": [{}]}]}]}, {"name": "b", "children": {"name": "not a list"}}]
    files = {
        "p1.task.json": {"creator_user_id": " ann ", "filename": "one.pdf", "progress": 40, "status": "parsing", "created_at": "2024-01-01"},
        "p1.json": {"outline": deep, "title_info": {"title": "Title"}, "generated_sections": {"1": "x", "2": "y"}, "stats": {"compliance_issue_count": 7}, "compliance_report": {"issues": [1]}, "consistency_report": {"conflicts": [1, 2]}},
        "p2.task.json": {"creator_user_id": "ann", "filename": "", "progress": None},
        "p3.json": {"outline": []},
        "p4.task.json": "{broken",
        "p4.json": {"outline": [{}]},
        "p5.task.json": {"creator_user_id": "ann"},
        "p5.json": "[1",
        "p6.task.json": {"creator_user_id": "bob"},
        "p6.json": {},
        "p7.task.json": ["no object"],
        "notes.txt": "x",
    }
    for i, (name, value) in enumerate(files.items()):
        p = tmp_path / name
        p.write_text(value if isinstance(value, str) else json.dumps(value))
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    return tmp_path, deep


def test_projects_of_an_owner(spark, folder):
    path, deep = folder
    got = rows(P.projects(P.json_files(spark, str(path)), "ann"))
    assert [g["id"] for g in got] == ["p5", "p2", "p1"]  # newest first
    one = got[2]
    assert (one["filename"], one["project_name"], one["status"], one["progress"], one["company_id"]) == ("one.pdf", "Title", "parsing", 40, "default")
    assert one["outline_count"] == nodes(deep) == 6
    assert (one["generated_section_count"], one["compliance_issue_count"], one["consistency_conflict_count"]) == (2, 7, 2)
    two, five = got[1], got[0]
    assert (two["filename"], two["project_name"], two["status"], two["progress"], two["has_result"], two["outline_count"]) == ("p2", "p2", "pending", 0, False, 0)
    assert (five["has_result"], five["status"], five["progress"]) == (True, "pending", 0)  # a broken result is there, but empty


def test_all_projects_and_limits(spark, folder):
    files = P.json_files(spark, str(folder[0]))
    got = {g["id"]: g for g in rows(P.projects(files))}
    assert sorted(got) == ["p1", "p2", "p3", "p4", "p5", "p6", "p7"]
    assert got["p3"]["status"] == "done" and got["p3"]["progress"] == 100 and got["p6"]["status"] == "pending"
    assert got["p4"]["outline_count"] == 1
    assert len(rows(P.projects(files, limit=0))) == 1 and len(rows(P.projects(files, limit=2))) == 2
    assert rows(P.projects(files, "nobody")) == []


def test_files_without_times_and_equal_ones(spark):
    files = spark.createDataFrame([("b.task.json", None, '{"created_at": "2024-02"}'), ("a.task.json", None, '{"created_at": "2024-02"}'), ("c.json", None, None), ("d.txt", None, "{}")], "name string, modified timestamp, text string")
    assert [g["id"] for g in rows(P.projects(files))] == ["a", "b", "c"]
    assert rows(P.projects(files.limit(0))) == []


def test_templates_are_saved_replaced_and_deleted(spark, tmp_path):
    where = str(tmp_path / "t")
    schema = "name string, category string, outline string, created_at string"
    P.save_templates(spark.createDataFrame([("A b/c", "x", '[{"name": "1"}, {"name": "2"}]', "1"), ("D", None, None, "1"), ("D", "y", '[{"n": "Ä\\n"}]', "2")], schema), where)
    first = {g["id"]: g for g in rows(P.templates(P.read_templates(spark, where)))}
    assert {k: (g["name"], g["category"], g["chapter_count"]) for k, g in first.items()} == {"A_b_c": ("A b/c", "x", 2), "D": ("D", "y", 1)}
    untouched = sorted(p.name for p in (tmp_path / "t" / "id=A_b_c").glob("part*"))
    P.save_templates(spark.createDataFrame([("D", "z", '[1, 2, 3]', "3")], schema), where)
    docs = P.read_templates(spark, where)
    assert {g["id"]: g["chapter_count"] for g in rows(P.templates(docs))} == {"A_b_c": 2, "D": 3}
    assert sorted(p.name for p in (tmp_path / "t" / "id=A_b_c").glob("part*")) == untouched
    assert json.loads(docs.where("id = 'D'").first()["text"])["meta"] == {"name": "D", "category": "z", "created_at": "3"}
    assert "PartitionFilters: [isnotnull(id" in docs.where("id = 'D'")._jdf.queryExecution().toString()
    P.delete_template(spark, where, "D")
    assert [g["id"] for g in rows(P.templates(P.read_templates(spark, where)))] == ["A_b_c"]
    with pytest.raises(KeyError):
        P.delete_template(spark, where, "D")
    with pytest.raises(Exception, match="needs a name"):
        P.save_templates(spark.createDataFrame([(" ", None, None, "1")], schema), where)


def test_broken_templates_give_no_row(spark):
    docs = spark.createDataFrame([("a", "{"), ("b", "[]"), ("c", "{}"), ("d", None), ("e", '{"outline": {"x": 1, "y": 2}}')], "id string, text string")
    assert {g["id"]: (g["name"], g["category"], g["chapter_count"]) for g in rows(P.templates(docs))} == {"c": ("c", P.NO_CATEGORY, 0), "e": ("e", P.NO_CATEGORY, 2)}
