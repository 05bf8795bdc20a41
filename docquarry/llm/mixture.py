"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.ranking import positions
from docquarry.runtime import checkpointed, join_small

WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST_COPIES = 3
SEED = 20_240_611


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def offset(seed: int = SEED) -> float:
    """The one random offset of a run: it depends on the seed only, so reruns agree."""
    return random.Random(seed).random()


def targets(sources: DataFrame, order: Sequence[str], weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sources has a row per source with source_size; adds target.

    The source at place i in order weighs weights[i % len(weights)]. Targets are min(most * source_size, level * weight)
    for the one level at which they sum to all sizes: what capping one source frees goes to the others by weight. With
    sources by rising most * source_size / weight, the capped ones are a prefix, so running sums give the level.
    The table has a row per source, so its two unpartitioned windows are small.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(Window.orderBy(*order)) - 1) % len(weights) + 1)
    s = sources.withColumn("q_w", w).withColumn("q_cap", F.col("source_size").cast("double") * most)
    s = s.withColumn("q_ratio", F.col("q_cap") / F.col("q_w"))
    rising = Window.orderBy("q_ratio", *order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("q_ratio", *order).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("q_level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("q_cap").over(rising), F.lit(0.0))) / F.sum("q_w").over(rest))
    s = s.withColumn("q_level", F.min(F.when(F.col("q_level") <= F.col("q_ratio"), F.struct("q_ratio", "q_level"))).over(every)["q_level"])
    return s.withColumn("target", F.least("q_cap", F.coalesce(F.col("q_level") * F.col("q_w"), F.col("q_cap")))).drop("q_w", "q_cap", "q_ratio", "q_level")


def sample_copies(rows: DataFrame, order: Sequence[str], weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """rows: source, size and the columns of order. Adds source_size, target, copies.

    Each row of a source is expected target / source_size times. The running sum of that, plus the random offset,
    gives a copy at each whole number passed, so copies are the expected number rounded down or up. Rows run by size, so every
    stretch of similar sizes gives its share and a source's taken size is off its target by about one row's size.
    Null source is a source of its own, last. Empty input: no rows.
    """
    keyed = rows.withColumn("q_null", F.col("source").isNull()).withColumn("q_src", F.coalesce("source", F.lit("")))
    placed = positions(keyed, ["size", *order], ["q_null", "q_src"], value=None)
    placed = checkpointed(placed)
    sums = placed.groupBy("q_null", "q_src").agg(F.sum("size").alias("source_size"))
    placed = join_small(placed, checkpointed(targets(sums, ["q_null", "q_src"], weights, most)), ["q_null", "q_src"])
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(1.0))
    place = F.col("q_pos").cast("double")
    u = F.lit(offset(seed))
    placed = placed.withColumn("copies", F.least(F.lit(most), F.floor((place + 1) * rate + u) - F.floor(place * rate + u)).cast("int"))
    return placed.drop("q_null", "q_src", "q_pos", "q_rows")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size (words), source_size, target, taken (words, repeats counted), copies."""
    rows = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))
    return sample_copies(rows, ["doc_id"], **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of docs as often as it was drawn, all columns kept, whatever their names.

    Rows that are equal in every column are counted together, so repeated rows keep their total number of copies. The row
    travels as one struct beside its key, so no column of docs can clash with those that the drawing needs.
    """
    key = [F.coalesce("doc_id", F.lit(-1)).alias("q_doc"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_hash")]
    rows = docs.select("doc_id", key[1], "source", words_in(F.col("text")).alias("size"))
    drawn = sample_copies(rows, ["doc_id", "q_hash"], **options).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("q_doc"), "q_hash").agg(F.sum("copies").alias("q_copies"), F.count(F.lit(1)).alias("q_same"))
    once = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row"))
    drawn = checkpointed(drawn)
    hot = drawn.where("q_same > 1 and q_copies > 0")
    single = once.join(drawn.where("q_same = 1 and q_copies > 0").drop("q_same"), ["q_doc", "q_hash"])
    several = join_small(once, checkpointed(hot.drop("q_same")), ["q_doc", "q_hash"]).dropDuplicates(["q_doc", "q_hash"])
    both = single.unionByName(several)
    return both.select("q_row", F.explode(F.sequence(F.lit(1), F.col("q_copies").cast("int"))).alias("q_copy")).select("q_row.*")


#: Window over the words' counts in DuckDB: the same order, offset and water level as sample_copies.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]}.0 WHEN 1 THEN {WEIGHTS[1]}.0 ELSE {WEIGHTS[2]}.0 END)::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, (source_size * {MOST_COPIES})::DOUBLE AS cap, source_size * {MOST_COPIES} / w AS ratio FROM s),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l AS k WHERE k.level <= k.ratio ORDER BY k.ratio LIMIT 1) * w, cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least({float(MOST_COPIES)}::DOUBLE, t.target / t.source_size) ELSE 1.0::DOUBLE END AS rate,
  (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1)::DOUBLE AS pos FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least({MOST_COPIES}, floor((pos + 1) * rate + {offset()!r}::DOUBLE) - floor(pos * rate + {offset()!r}::DOUBLE)))::INT * size AS taken,
  (least({MOST_COPIES}, floor((pos + 1) * rate + {offset()!r}::DOUBLE) - floor(pos * rate + {offset()!r}::DOUBLE)))::INT AS copies FROM p
"""
