"""Facts said in sections of a project, and where they contradict each other, a locked fact, or the order of events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of facts of which a project may say one value for a key only.
SINGLE = ("amount", "number", "party", "role")


def occurrences(sections: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """project, kind, key, value, section, place of each fact. sections: project, section (in order), text; rules: (kind, key, pattern whose first group is the value).

    All rules read a text in one pass. place counts a rule's matches in a section. Dates that are none are left out, as are blank values.
    """
    found = lambda kind, key, pattern: F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1)), lambda v, i: F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), F.trim(v).alias("value"), i.alias("place")))
    rows = sections.select("project", "section", F.explode(F.flatten(F.array(*[found(*r) for r in rules]))).alias("f")).select("project", "f.kind", "f.key", "f.value", "section", "f.place")
    date = F.try_to_date("value", "yyyy-MM-dd")
    return rows.where("value <> ''").withColumn("value", F.when(F.col("kind") == "date", date.cast("string")).otherwise(F.col("value"))).where("value IS NOT NULL")


def first_said(facts: DataFrame) -> DataFrame:
    """project, kind, key, value, first (section, place): a row per value, with where it is first said. Repeats are folded before any value meets another."""
    return facts.groupBy("project", "kind", "key", "value").agg(F.min(F.struct("section", "place")).alias("first"))


def _told(values: DataFrame, conflict: Column) -> DataFrame:
    """project, conflict, key, vals (rising), places (section:place of each value's first occurrence, by place)."""
    listed = values.groupBy("project", conflict.alias("conflict"), "key").agg(F.array_sort(F.collect_set("value")).alias("v"), F.array_sort(F.collect_list("first")).alias("p"))
    place = F.transform("p", lambda x: F.concat(x["section"].cast("string"), F.lit(":"), x["place"].cast("string")))
    return listed.select("project", "conflict", "key", F.array_join("v", ",").alias("vals"), F.array_join(place, " ").alias("places"))


def contradictions(facts: DataFrame) -> DataFrame:
    """Keys of SINGLE kinds with more than one value; conflict is the kind."""
    values = first_said(facts.where(F.col("kind").isin(*SINGLE)))
    several = values.groupBy("project", "kind", "key").count().where("count > 1").drop("count")
    return _told(values.join(several, ["project", "kind", "key"], "left_semi"), F.col("kind"))


def event_dates(facts: DataFrame, locked: DataFrame, events: Sequence[str]) -> DataFrame:
    """project and a column per event: its locked date, else the first date said. locked: project, key, value (a date as text)."""
    dates = facts.where("kind = 'date'")
    said = dates.groupBy("project", "key").agg(F.min_by("value", F.struct("section", "place")).alias("said"))
    both = said.join(locked.select("project", "key", F.col("value").alias("locked")), ["project", "key"], "full")
    return both.groupBy("project").pivot("key", list(events)).agg(F.first(F.coalesce("locked", "said")))


def order_conflicts(dates: DataFrame, order: Sequence[tuple[str, str]]) -> DataFrame:
    """project, conflict, key, vals, places: pairs (earlier, later) of events whose dates stand the other way round; equal dates don't."""
    rows = F.filter(F.array(*[F.struct(F.lit(f"{a}<{b}").alias("key"), F.concat_ws(",", a, b).alias("vals"), (F.col(b) < F.col(a)).alias("wrong")) for a, b in order]), lambda x: x["wrong"])
    return dates.select("project", F.explode(rows).alias("r")).select("project", F.lit("order").alias("conflict"), "r.key", "r.vals", F.lit("").alias("places"))


def locked_conflicts(facts: DataFrame, locked: DataFrame) -> DataFrame:
    """Dates said that differ from the event's locked one."""
    values = first_said(facts.where("kind = 'date'")).join(locked.select("project", "key", F.col("value").alias("q_locked")), ["project", "key"]).where("value <> q_locked").drop("q_locked")
    return _told(values, F.lit("locked"))


def report(sections: DataFrame, rules: Sequence[tuple[str, str, str]], locked: DataFrame, order: Sequence[tuple[str, str]]) -> DataFrame:
    """project, conflict (a kind of SINGLE, order or locked), key, vals, places of every conflict of every project; null projects are one project."""
    facts = occurrences(sections, rules)
    events = sorted({e for pair in order for e in pair})
    return reduce(DataFrame.unionByName, (contradictions(facts), order_conflicts(event_dates(facts, locked, events), order), locked_conflicts(facts, locked)))
