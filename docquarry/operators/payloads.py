"""JSON payloads as Variant values: a walk over all that they hold, and lists of loosely written items made uniform by a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.runtime import checkpointed, released

#: Fields of an item object that may bear its value, the first one that does wins.
VALUE_FIELDS = ("value", "name", "text")
#: Levels that are opened in one plan; deeper payloads are stored after so many.
STRETCH = 12
#: Words that stand for yes and no.
YES, NO = ("true", "yes", "y", "1", "是"), ("false", "no", "n", "0", "否")


def kind(value: Column) -> Column:
    """object, array, null, or scalar."""
    return kind_of(F.schema_of_variant(value))


def kind_of(schema: Column) -> Column:
    return F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "VOID", "null").otherwise("scalar")


def opened(rows: DataFrame, value: str) -> DataFrame:
    """rows once for each element or field of the Variant column: q_pos, q_key (null in arrays), q_value in place of value."""
    parts = rows.sparkSession.tvf.variant_explode(F.col(value).outer()).toDF("q_pos", "q_key", "q_value")
    return rows.lateralJoin(parts).drop(value)


def depth(value: Column) -> Column:
    """How many containers stand inside each other at most, by the brackets of its JSON text outside of strings; 0 for scalars and null."""
    bare = F.regexp_replace(F.regexp_replace(F.to_json(value), r"\\.", ""), '"[^"]*"', "")
    marks = F.split(F.translate(F.regexp_replace(bare, r"[^\[\]{}]", ""), "{}", "[]"), "")
    step = lambda z, x: F.when(x == "[", F.struct((z["now"] + 1).alias("now"), F.greatest(z["most"], z["now"] + 1).alias("most"))).when(x == "]", F.struct((z["now"] - 1).alias("now"), z["most"].alias("most"))).otherwise(z)
    return F.coalesce(F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda z: z["most"]), F.lit(0))


def walk(rows: DataFrame, value: str, containers: tuple[str, ...] = ("object", "array"), follow: Column | None = None) -> DataFrame:
    """rows once for every node below and including value that isn't opened: path ($.a[0].b), places (a list that sorts them in order), kind, value.

    Containers of the given kinds are opened, level by level, until none is left, so the depth may be any; follow (over path and kind)
    holds back containers that it is false for. Empty containers vanish; null values (not JSON nulls) give no rows. The levels are as many as
    the deepest value has, which a first pass tells; all are one chain of rows that are told once and not stored, but after each STRETCH of them.
    """
    own = [c for c in rows.columns if c != value]
    more = F.col("kind").isin(*containers) & (follow if follow is not None else F.lit(True))
    levels = rows.agg(F.max(depth(F.col(value)))).first()[0] or 0
    released(rows.sparkSession)  # what the first pass shuffled
    front = rows.where(F.col(value).isNotNull()).select(*own, F.lit("$").alias("path"), F.array().cast("array<int>").alias("places"), F.col(value).alias("value")).withColumn("kind", kind(F.col("value")))
    for level in range(levels):
        if level and level % STRETCH == 0:
            front = checkpointed(front)
        front = front.withColumn("q_more", more).withColumn("q_open", F.when(F.col("q_more"), F.col("value")))
        inner = front.lateralJoin(front.sparkSession.tvf.variant_explode_outer(F.col("q_open").outer()).toDF("q_pos", "q_key", "q_value")).where("q_pos IS NOT NULL OR NOT coalesce(q_more, false)")
        step = F.when(F.col("kind") == "object", F.concat(F.lit("."), "q_key")).otherwise(F.concat(F.lit("["), F.col("q_pos").cast("string"), F.lit("]")))
        now = lambda new, old: F.when(F.col("q_more"), new).otherwise(F.col(old)).alias(old)
        inner = inner.withColumn("q_schema", F.when(F.col("q_more"), F.schema_of_variant("q_value")))  # once, not for each kind
        front = inner.select(*own, now(F.concat("path", step), "path"), now(F.concat("places", F.array("q_pos")), "places"), now(F.col("q_value"), "value"), now(kind_of(F.col("q_schema")), "kind"))
    return front.withColumn("kind", F.when(more, F.raise_error(F.lit("a container is deeper than the first pass told"))).otherwise(F.col("kind")))


def scalar(value: Column, path: str = "$") -> Column:
    """The text of a scalar at path; null for containers, JSON nulls, blanks and what isn't there."""
    at = F.try_variant_get(value, path, "variant")
    text = F.when(kind(at) == "scalar", F.try_variant_get(value, path, "string"))
    return F.when(F.trim(text) != "", text)


def flag(value: Column, path: str) -> Column:
    """A truth at path, as a JSON truth or a word for one; null for all else."""
    said = F.lower(F.trim(scalar(value, path)))
    return F.when(said.isin(*YES), True).when(said.isin(*NO), False)


def atoms(rows: DataFrame, value: str) -> DataFrame:
    """rows once for every item: places, atom, quote, item. Lists are opened to any depth; an item is a scalar or an object.

    A scalar is its own quote. An object's atom is the first of VALUE_FIELDS that bears a scalar, its quote its field quote or
    else the atom. Nulls, blanks and objects without such a field are no items.
    """
    flat = walk(rows, value, containers=("array",)).where("kind <> 'null'")
    atom = F.coalesce(scalar(F.col("value")), *[scalar(F.col("value"), f"$.{f}") for f in VALUE_FIELDS])
    own = [c for c in rows.columns if c != value]
    made = flat.withColumn("atom", atom).where("atom IS NOT NULL")
    return made.select(*own, "places", "atom", F.coalesce(scalar(F.col("value"), "$.quote"), "atom").alias("quote"), F.col("value").alias("item"))


def normalised(payloads: DataFrame, key: str, payload: str, rules: list[tuple[str, bool, bool, str]]) -> DataFrame:
    """key, list, pos (from 0), atom, quote, mandatory, required, severity of every item of every list that the rules name.

    rules: (field of the payload, default of mandatory, of required, of severity), a row a list. A field may hold a list, a
    single item or nothing. Text that is no JSON object has no lists. severity is taken as it is written, in lower case.
    """
    parsed = payloads.select(key, F.try_parse_json(payload).alias("q_v")).where(kind(F.col("q_v")) == "object")
    table = F.array(*[F.struct(F.lit(name).alias("list"), F.lit(m).alias("m"), F.lit(r).alias("r"), F.lit(s).alias("s")) for name, m, r, s in rules])
    fields = opened(parsed, "q_v").select(key, F.col("q_key").alias("list"), F.col("q_value").alias("v"))
    ruled = fields.withColumn("q_rule", F.get(F.filter(table, lambda x: x["list"] == F.col("list")), F.lit(0))).where("q_rule IS NOT NULL")
    items = atoms(ruled, "v")
    asked = lambda path, field: F.coalesce(flag(F.col("item"), path), F.col(f"q_rule.{field}"))
    out = items.select(key, "list", "places", "atom", "quote", asked("$.mandatory", "m").alias("mandatory"), asked("$.required", "r").alias("required"), F.coalesce(F.lower(scalar(F.col("item"), "$.severity")), "q_rule.s").alias("severity"))
    listed = out.groupBy(key, "list").agg(F.array_sort(F.collect_list(F.struct("places", "atom", "quote", "mandatory", "required", "severity"))).alias("x"))
    return listed.select(key, "list", F.posexplode("x").alias("pos", "q")).select(key, "list", "pos", "q.atom", "q.quote", "q.mandatory", "q.required", "q.severity")
