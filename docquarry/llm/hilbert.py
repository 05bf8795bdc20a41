"""Sharding along a Hilbert curve through several metadata dimensions. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.operators.ranking import positions

#: Bits per dimension of the curve.
BITS = 5


@cache
def curve_table(dims: int) -> tuple[int, ...]:
    """For entry corner e, direction d and sub-cell l: (next e, next d, place of l on the curve) as one integer.

    Row (e * dims + d) * 2**dims + l holds ((e' * dims + d') << dims) | w, by Gray codes and rotations of dims bits.
    """
    full = (1 << dims) - 1

    def left(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & full

    def gray(x: int) -> int:
        return x ^ (x >> 1)

    place = {gray(i): i for i in range(full + 1)}
    ones = [((x + 1) & -(x + 1)).bit_length() - 1 for x in range(full + 1)]
    out = []
    for e in range(full + 1):
        for d in range(dims):
            for cell in range(full + 1):
                w = place[left(cell ^ e, dims - (d + 1) % dims)]
                entry = gray(2 * ((w - 1) // 2)) if w else 0
                turn = 0 if not w else ones[w - 1] % dims if w % 2 == 0 else ones[w] % dims
                out.append((((e ^ left(entry, d + 1)) * dims + (d + turn + 1) % dims) << dims) | w)
    return tuple(out)


def curve_index(levels: Sequence[Column], bits: int = BITS) -> Column:
    """The Hilbert index of a cell, given its coordinates (0 to 2**bits - 1 each)."""
    n = len(levels)
    table = F.array(*[F.lit(x) for x in curve_table(n)])
    cells = F.array(*[reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1)), j) for j, x in enumerate(levels)]) for b in reversed(range(bits))])
    full = F.lit((1 << n) - 1)

    def step(acc: Column, cell: Column) -> Column:
        got = F.get(table, F.shiftleft(acc["s"], n).bitwiseOR(cell))
        return F.struct(F.shiftleft(acc["h"], n).bitwiseOR(got.bitwiseAND(full).cast("long")).alias("h"), F.shiftright(got, n).alias("s"))

    return F.aggregate(cells, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s")), step, lambda acc: acc["h"])


def _number(df: DataFrame, name: str) -> Column:
    """An order-keeping number of a column: strings by their first 7 UTF-8 bytes; null below all."""
    if isinstance(df.schema[name].dataType, T.StringType):
        head = F.hex(F.substring(F.encode(F.col(name), "UTF-8"), 1, 7))
        return F.coalesce(F.conv(F.rpad(head, 14, "0"), 16, 10).cast("long"), F.lit(-1))
    return F.coalesce(F.col(name).cast("long"), F.lit(-(1 << 62)))


def shards(df: DataFrame, dims: Sequence[str], n_shards: int, size: Column, tie: Sequence[str], law: str = "rows", keep: dict[str, Column] | None = None) -> DataFrame:
    """Deals rows to n_shards runs of the curve through dims, each quantised to 2**BITS equal-depth levels.

    law "rows": counts differ by one at most; "bytes": each cut is where the prefix sum of sizes passes its share, so
    a shard's size is off by one row's size at most. Returns tie, keep and curve, size, shard, slot (0.. in a shard).
    Nulls in dims take the lowest level; rows equal in all of tie and curve may swap slots; an empty table gives no
    rows; fewer rows than shards leave shards empty. Levels come from quantile sketches over all rows; the cuts are exact.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(law)
    cuts = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    numbers = [_number(df, d) for d in dims]
    row = df.select(*[n.alias(f"q_d{j}") for j, n in enumerate(numbers)]).agg(*[F.percentile_approx(f"q_d{j}", cuts, 10_000).alias(f"q_d{j}") for j in range(len(dims))]).first()
    levels = [reduce(lambda a, b: a + b, [(n > F.lit(int(c))).cast("int") for c in row[j] or []], F.lit(0)) for j, n in enumerate(numbers)]
    own = {**{t: F.col(t) for t in tie}, **(keep or {})}
    cells = df.select(*[c.alias(k) for k, c in own.items()], size.cast("long").alias("size"), *[x.alias(f"q_l{j}") for j, x in enumerate(levels)])
    cells = cells.select(*own, "size", curve_index([F.col(f"q_l{j}") for j in range(len(dims))]).alias("curve"))
    placed = positions(cells, ["curve", *tie], value="size" if law == "bytes" else None)
    if law == "rows":
        placed = placed.withColumn("shard", F.expr(f"cast(q_pos * {n_shards} div q_rows as int)"))
        return placed.withColumn("slot", F.expr(f"q_pos - (shard * q_rows + {n_shards - 1}) div {n_shards}")).drop("q_pos", "q_rows")
    placed = placed.withColumn("shard", F.expr(f"cast(least({n_shards - 1}, (q_before + size div 2) * {n_shards} div greatest(q_sum, 1)) as int)"))
    first = placed.groupBy("shard").agg(F.min("q_pos").alias("q_start"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("q_pos") - F.col("q_start")).drop("q_pos", "q_rows", "q_before", "q_sum", "q_start")


def document_shards(docs: DataFrame, n_shards: int = 40, law: str = "rows") -> DataFrame:
    """Documents by length, language, source and id: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    text = F.coalesce("text", F.lit(""))
    out = shards(docs, ["n_chars", "lang", "source", "doc_id"], n_shards, F.octet_length(text) + 16, ["doc_id", "text_crc32"], law, {"text_crc32": F.crc32(text)})
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
