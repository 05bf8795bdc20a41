"""Folders of JSON documents: projects as pairs of a task file and a result file, and a library of outline templates.

Every file is a row (name, modified, text); one that can't be parsed is a row without a value, never an error. A file must fit in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.payloads import kind, opened
from docquarry.operators.scanning import stripped
from docquarry.runtime import checkpointed, removed

#: Suffixes, the most projects a list shows, and what stands for a missing category.
TASK, RESULT, MOST, NO_CATEGORY = ".task.json", ".json", 500, "未分类"


def json_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, modified, text of the folder's JSON files."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    return files.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def _told(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _said(path: str, kind: str = "string") -> Column:
    value = F.try_variant_get(F.col("v"), path, kind)
    return _told(value) if kind == "string" else F.nullif(value, F.lit(0).cast(kind))


def _size(path: str, kind: str) -> Column:
    value = F.try_variant_get(F.col("v"), path, kind)
    return F.when(value.isNull(), 0).otherwise(F.cardinality(value)).cast("long")


def outline_counts(values: DataFrame, key: str, outline: str) -> DataFrame:
    """key, nodes: objects in the Variant outline (a list) and, to any depth, in their lists of children; keys without any give no row."""
    front, done = values.select(key, F.col(outline).alias("q_list")), []
    while True:
        nodes = checkpointed(opened(front.where(kind(F.col("q_list")) == "array"), "q_list").where(kind(F.col("q_value")) == "object").select(key, "q_value"))
        done.append(nodes.groupBy(key).count())
        if nodes.isEmpty():
            return reduce(DataFrame.unionByName, done).groupBy(key).agg(F.sum("count").alias("nodes"))
        front = nodes.select(key, F.try_variant_get("q_value", "$.children", "variant").alias("q_list"))


def projects(files: DataFrame, owner: str | None = None, limit: int = 100, company: str = "default") -> DataFrame:
    """The newest projects of an owner (of all, if None): one per id that has a task or a result file, at most 1 to 500.

    What a task file leaves out or leaves empty comes from the result, else from a default; counts come from the result's statistics, else
    from what it holds. A task file that is missing or broken has no owner; a broken result counts as there, but empty. Newest by the later
    of both files' times, else by the time of creation; ties by id.
    """
    is_task = F.col("name").endswith(TASK)
    ids = files.where(F.col("name").endswith(RESULT)).withColumns({"task": is_task, "id": F.when(is_task, F.regexp_replace("name", r"\.task\.json$", "")).otherwise(F.regexp_replace("name", r"\.json$", ""))})
    # What is no object counts as nothing.
    parsed = ids.select("id", "task", "modified", F.try_parse_json("text").alias("v")).withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    strings = ("creator_user_id", "filename", "company_id", "company_name", "status", "message", "error", "created_at")
    tasks = parsed.where("task").select("id", F.col("modified").alias("task_at"), F.try_variant_get("v", "$.progress", "int").alias("progress"), *[_said(f"$.{s}").alias(s) for s in strings])
    results = parsed.where("NOT task")
    nodes = outline_counts(results.select("id", F.try_variant_get("v", "$.outline", "variant").alias("outline")), "id", "outline")
    told = results.select(
        "id", F.col("modified").alias("result_at"), F.coalesce(F.cardinality(F.try_variant_get("v", "$", "map<string,variant>")) > 0, F.lit(False)).alias("filled"),
        F.coalesce(_said("$.title_info.project_name"), _said("$.title_info.title")).alias("title"), _said("$.title_info.purchaser").alias("purchaser"),
        F.coalesce(_said("$.stats.generated_section_count", "long"), _size("$.generated_sections", "map<string,variant>")).alias("generated_section_count"),
        F.coalesce(_said("$.stats.compliance_issue_count", "long"), _size("$.compliance_report.issues", "array<variant>")).alias("compliance_issue_count"),
        F.coalesce(_said("$.stats.consistency_conflict_count", "long"), _size("$.consistency_report.conflicts", "array<variant>")).alias("consistency_conflict_count"),
        F.lit(True).alias("there"),
    )
    both = tasks.join(told, "id", "full_outer")
    if owner is not None:
        both = both.where(stripped(F.col("creator_user_id")) == owner)
    filled, zero = F.coalesce("filled", F.lit(False)), lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    shown = both.select(
        "id", F.coalesce("filename", "id").alias("filename"), F.coalesce("title", "filename", "id").alias("project_name"), F.coalesce("purchaser", F.lit("")).alias("purchaser"),
        F.coalesce("company_id", F.lit(company)).alias("company_id"), F.coalesce("company_name", F.lit("")).alias("company_name"),
        F.coalesce("status", F.when(filled, "done").otherwise("pending")).alias("status"), F.coalesce(F.nullif("progress", F.lit(0)), F.when(filled, 100).otherwise(0)).alias("progress"),
        F.coalesce("message", F.lit("")).alias("message"), "error", "created_at", F.greatest("task_at", "result_at").alias("updated_at"), F.coalesce("there", F.lit(False)).alias("has_result"),
        zero("generated_section_count"), zero("compliance_issue_count"), zero("consistency_conflict_count"),
    )
    first = shown.orderBy(F.coalesce(F.col("updated_at").cast("string"), F.col("created_at"), F.lit("")).desc(), "id").limit(max(1, min(limit, MOST)))
    return first.join(nodes, "id", "left").withColumn("outline_count", F.coalesce("nodes", F.lit(0)).cast("long")).drop("nodes")


def templates(documents: DataFrame) -> DataFrame:
    """id, name, category, chapter_count, created_at of the templates (id, text: {meta, outline}); broken ones and those that are no objects give no row."""
    rows = documents.select("id", F.try_parse_json("text").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    chapters = F.greatest(_size("$.outline", "array<variant>"), _size("$.outline", "map<string,variant>"))
    return rows.select(
        "id", F.coalesce(F.try_variant_get("v", "$.meta.name", "string"), F.col("id")).alias("name"), F.coalesce(F.try_variant_get("v", "$.meta.category", "string"), F.lit(NO_CATEGORY)).alias("category"),
        chapters.alias("chapter_count"), F.try_variant_get("v", "$.meta.created_at", "string").alias("created_at"),
    )


def template_documents(rows: DataFrame) -> DataFrame:
    """id, text of the templates that rows (name, category, outline as JSON, created_at) describe: the latest one of each id. A blank name is an error."""
    name = stripped(F.col("name"))
    named = F.when(name == "", F.raise_error(F.lit("a template needs a name"))).otherwise(name)
    meta = F.struct(named.alias("name"), F.coalesce("category", F.lit(NO_CATEGORY)).alias("category"), F.col("created_at").cast("string").alias("created_at"))
    text = F.concat(F.lit('{"meta":'), F.to_json(meta), F.lit(',"outline":'), F.coalesce("outline", F.lit("[]")), F.lit("}"))
    return rows.select(F.translate(named, " /", "__").alias("id"), "created_at", text.alias("text")).groupBy("id").agg(F.max_by("text", F.struct("created_at", "text")).alias("text"))


def save_templates(rows: DataFrame, folder: str) -> None:
    """Writes or replaces the templates of rows, one folder each; other templates aren't touched."""
    template_documents(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id").text(folder)


def read_templates(spark: SparkSession, folder: str) -> DataFrame:
    """id, text of all templates; a filter on id reads its folder only."""
    return spark.read.schema("value string, id string").option("wholetext", True).option("basePath", folder).text(folder).select("id", F.col("value").alias("text"))


def delete_template(spark: SparkSession, folder: str, template: str) -> None:
    """Deletes a template; one that isn't there is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/id={template}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise KeyError(template)
    removed(spark, f"{folder}/id={template}")
