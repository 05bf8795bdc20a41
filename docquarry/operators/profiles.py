"""Cosines of all pairs of count vectors in a group: quadratic by nature, made block by block without a row for each common part."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.runtime import ship

#: Vectors in a block on average; a task holds two blocks with PARTS columns at a time, their products, and the rows of SLICE vectors.
BLOCK, PARTS, SLICE = 1024, 512, 64


def rounded(x: np.ndarray) -> np.ndarray:
    """x to six places, halves away from zero by its shortest decimal form, as round() has it."""
    y = x * 1e6
    out = np.floor(y + 0.5) / 1e6
    close = np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-4)
    if len(close):
        few, back = np.unique(x[close], return_inverse=True)
        out[close] = np.array([float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in few.tolist()])[back]
    return out


def cosines(counts: DataFrame, key: str, group: str, part: str, n: str, other: str) -> DataFrame:
    """key, other, cosine: pairs of keys (the smaller one first) that have a part in common in a group, the cosine rounded to six places.

    counts: key (a whole number), group, part, n. Norms are over all of a key's groups; null keys, groups and parts meet none. Keys of a group are dealt over
    blocks by hash; each pair of blocks is a group of rows of its own, whose vectors a Python task multiplies slice by slice, so that a pair
    becomes one row, at the end, and nothing is summed up by pairs. Two keys that are both in several groups may meet more than once; they are joined part by part.
    """
    ship(counts.sparkSession)
    kind = counts.schema[key].dataType.simpleString()
    vectors = counts.where(F.col(key).isNotNull() & F.col(group).isNotNull() & F.col(part).isNotNull()).groupBy(F.col(key).alias("q_key"), F.col(group).alias("q_group")).agg(F.collect_list(part).alias("q_parts"), F.collect_list(F.col(n).cast("long")).alias("q_n"), F.sum(F.col(n) * F.col(n)).cast("long").alias("q_own"))
    whole = counts.groupBy(F.col(key).alias("q_key")).agg(F.sum(F.col(n) * F.col(n)).cast("long").alias("q_square"), (F.count_distinct(group) > 1).alias("q_several"))
    vectors = vectors.join(whole, "q_key").drop("q_own")
    many = vectors.groupBy("q_group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q_blocks"))
    blocked = vectors.join(many, "q_group").withColumn("q_block", F.pmod(F.xxhash64("q_key"), "q_blocks").cast("int"))
    dealt = blocked.withColumn("q_with", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    dealt = dealt.select("q_group", F.least("q_block", "q_with").alias("q_x"), F.greatest("q_block", "q_with").alias("q_y"), (F.col("q_block") > F.col("q_with")).alias("q_second"), "q_key", "q_several", "q_square", "q_parts", "q_n")
    dealt = dealt.withColumn("q_pair", F.xxhash64("q_group", "q_x", "q_y")).repartition("q_pair").sortWithinPartitions("q_pair", "q_group", "q_x", "q_y")

    def multiply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def products(same: bool, rows: list) -> Iterator[pa.RecordBatch]:
            places: dict = {}
            where = np.fromiter((places.setdefault(p, len(places)) for r in rows for p in r[4]), np.int64)
            row, times = np.repeat(np.arange(len(rows)), [len(r[4]) for r in rows]), np.concatenate([r[5] for r in rows]).astype(np.float64)
            keys, norms = np.array([r[1] for r in rows], np.int64), np.sqrt(np.array([r[3] for r in rows], np.float64))
            several, second = np.array([r[2] for r in rows], bool), np.array([r[0] for r in rows], bool)
            left = np.arange(len(rows)) if same else np.flatnonzero(~second)
            right = np.arange(len(rows)) if same else np.flatnonzero(second)
            dots = np.zeros((len(left), len(right)))
            for first in range(0, len(places), PARTS):
                here = (where >= first) & (where < first + PARTS)
                matrix = np.zeros((len(rows), PARTS))
                matrix[row[here], where[here] - first] = times[here]
                dots += matrix[left] @ matrix[right].T  # whole numbers, exact
            for lo in range(0, len(left), SLICE):
                at, some = left[lo : lo + SLICE], dots[lo : lo + SLICE]
                keep = (some > 0) & ~(several[at][:, None] & several[right])
                if same:
                    keep &= keys[at][:, None] < keys[right]
                i, j = np.nonzero(keep)
                a, b = at[i], right[j]
                turn = keys[a] > keys[b]
                a, b = np.where(turn, b, a), np.where(turn, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(keys[a]), pa.array(keys[b]), pa.array(rounded(some[i, j] / norms[a] / norms[b]))], ["key", "other", "cosine"])

        now, held = None, []
        for b in it:
            for *of, second, ident, several, square, parts, times in zip(*(b.column(c).to_pylist() for c in ("q_group", "q_x", "q_y", "q_second", "q_key", "q_several", "q_square", "q_parts", "q_n")), strict=True):
                if of != now and held:
                    yield from products(now[1] == now[2], held)
                    held = []
                now = of
                held.append((second, ident, several, square, parts, times))
        if held:
            yield from products(now[1] == now[2], held)

    made = dealt.mapInArrow(multiply, "key long, other long, cosine double").select(F.col("key").cast(kind).alias(key), F.col("other").cast(kind).alias(other), "cosine")
    some = counts.join(whole.where("q_several").select(F.col("q_key").alias(key), F.sqrt("q_square").alias("q_norm")), key)
    twin = some.select(F.col(key).alias(other), group, part, F.col(n).alias("q_m"), F.col("q_norm").alias("q_norm2"))
    met = some.join(twin, [group, part]).where(F.col(key) < F.col(other)).groupBy(key, other).agg(F.round(F.sum(F.col(n) * F.col("q_m")) / F.max("q_norm") / F.max("q_norm2"), 6).alias("cosine"))
    return made.unionByName(met)
