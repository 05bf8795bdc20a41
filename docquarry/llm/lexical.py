"""Ranked lexical search: an index of two levels, byte impacts for bounds and exact frequencies for the few documents that the bounds leave.

A document's score for an item is the sum over the item's terms of w * saturation, whole numbers throughout. The index has a
row per document. Its first level has, for each asked term that it holds, the saturation in units of UNIT, rounded up to a
byte: so many units, and one unit less, bound each term's share from above and below. The second level has the frequencies.
A search adds bytes over all documents, keeps those whose upper bound reaches the kth largest lower bound, and scores these exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.bytewords import CHUNK, Texts, read
from docquarry.llm.tokens import slices
from docquarry.runtime import checkpointed, join_small, materialised, ship

K = 10
#: Saturation is SCALE * tf div (TF_PART * tf + LENGTH_PART * m), which stays below SCALE / TF_PART.
SCALE, TF_PART, LENGTH_PART = 1_000_000_000, 1000, 8
#: Percent of m that follows the document's length.
LENGTH_SHARE = 75
UNIT = -(-SCALE // TF_PART // 255)
#: Items that are searched together; more are searched block by block, so the driver and the tasks hold one block's terms.
BLOCK = 1000
#: Cells of the dense table of bytes that a task makes at once.
CELLS = 1 << 20
#: Each byte as terms see it: letters, digits and bytes of longer code points stay, A-Z become small, all else parts terms.
_AS_TERM = np.array([b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)
_AS_TERM[65:91] = _AS_TERM[97:123]


def terms_of(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts whose words are the rows' terms), a bounded number of bytes at a time; null has none."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for lo, hi in slices(np.diff(offsets).tolist(), CHUNK):
        yield lo, hi, read(_AS_TERM[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], lower=False)


@dataclass
class Items:
    """A block of items: keys, ids, the distinct terms (hashes, sorted) of all, and for each item its terms' places and repeats."""

    keys: list[int]
    ids: list
    terms: np.ndarray
    asked: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        """rows: (key, item_id, text)."""
        hashes: list[np.ndarray] = []
        for _, _, t in terms_of(pa.array([r[2] for r in rows], pa.string())):
            hashes += [t.hashes[a:b] for a, b in zip(t.first[:-1], t.first[1:], strict=True)]
        terms = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        return Items([r[0] for r in rows], [r[1] for r in rows], terms, [np.unique(np.searchsorted(terms, h), return_counts=True) for h in hashes])

    def table(self, weights: np.ndarray) -> np.ndarray:
        """terms x items: weight times repeats."""
        out = np.zeros((len(self.terms), len(self.keys)))
        for i, (at, n) in enumerate(self.asked):
            out[at, i] = weights[at] * n
        return out


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """row (unique), doc_id, n_terms (all terms of the text), terms (places in `terms`, rising), tfs: for every document, one pass without a shuffle."""
    ship(docs.sparkSession)
    low = np.zeros(1 << 16, bool)
    low[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def rows(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, t in terms_of(batch.column(1)):
                text = np.repeat(np.arange(hi - lo), t.n_words)
                at = np.flatnonzero(low[(t.hashes & np.uint64(0xFFFF)).astype(np.int64)])
                place = np.minimum(np.searchsorted(terms, t.hashes[at]), max(len(terms) - 1, 0))
                hit = terms[place] == t.hashes[at] if len(terms) else np.zeros(len(at), bool)
                keys, tfs = np.unique(text[at[hit]] * max(len(terms), 1) + place[hit], return_counts=True)
                owner, which = np.divmod(keys, max(len(terms), 1))
                ends = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (which, tfs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(t.n_words.astype(np.int64)), *lists], ["doc_id", "n_terms", "terms", "tfs"])

    got = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_terms long, terms array<int>, tfs array<int>")
    return got.select(F.monotonically_increasing_id().alias("row"), "*")


@dataclass
class Index:
    """levels: row, doc_id, n_terms, tfs (second level) and terms, impacts (first level: a byte per term); weights by place."""

    levels: DataFrame
    docs: int
    length: int
    weights: np.ndarray


def build(docs: DataFrame, terms: np.ndarray) -> Index:
    """Indexes every document for the given terms (hashes, sorted). The statistics cover all documents and all their terms."""
    table = materialised(postings(docs, terms))
    n, length = (int(x or 0) for x in table.agg(F.count_if(F.col("n_terms") > 0), F.sum("n_terms")).first())
    df = np.zeros(len(terms), np.int64)
    for place, count in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per asked term of the block at most
        df[place] = count
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def rows(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            offsets, tfs = _lists(b.column(4))
            lengths = np.repeat(b.column(2).to_numpy(), np.diff(offsets))
            units = -(-saturation(tfs, lengths, n, length) // UNIT)
            binary = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(units.astype(np.uint8))])
            yield pa.RecordBatch.from_arrays([*b.columns, binary], [*b.schema.names, "impacts"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    levels = materialised(table.mapInArrow(rows, f"{fields}, impacts binary"))
    return Index(levels, n, length, weights)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column, offsets from 0."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten().to_numpy().astype(np.int64)


def saturation(tf: np.ndarray, n_terms: np.ndarray, n: int, length: int) -> np.ndarray:
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n_terms * n) // max(length, 1)
    return (SCALE * tf) // (TF_PART * tf + LENGTH_PART * m)


class _Best:
    """Per item the k largest lower bounds so far, and the documents whose upper bound reaches the kth of them."""

    def __init__(self, items: int, k: int):
        self.lows = np.zeros((k, items))
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = self.kept = 0

    def see(self, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        k = len(self.lows)
        self.lows = np.partition(np.vstack([self.lows, low]), len(low), axis=0)[len(low) :]
        at, item = np.nonzero((high > 0) & (high >= self.lows.min(axis=0)))
        self.found.append((item, row[at], low[at, item], high[at, item]))
        self.size += len(at)
        if self.size > max(2 * self.kept, 100 * k):
            self.found = [self.rest()]
            self.size = self.kept = len(self.found[0][0])

    def rest(self) -> tuple[np.ndarray, ...]:
        item, row, low, high = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64),) * 4
        keep = high >= self.lows.min(axis=0)[item]
        return item[keep], row[keep], low[keep], high[keep]


def bounds(index: Index, items: Items, k: int) -> DataFrame:
    """item (key), row, low, high (long): in each task, the documents whose upper bound reaches the task's kth lower bound; no other pair becomes a row."""
    table = items.table(index.weights)
    keys = np.array(items.keys, np.int64)
    wide = max(1, CELLS // max(1, len(items.terms)))

    def rows(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(keys), k)
        for b in it:
            offsets, terms = _lists(b.column(1))
            impacts = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8)
            row = b.column(0).to_numpy()
            for lo in range(0, len(b), wide):
                hi = min(len(b), lo + wide)
                part = slice(offsets[lo], offsets[hi])
                dense = np.zeros((hi - lo, len(items.terms)))
                dense[np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])), terms[part]] = impacts[part]
                some = np.flatnonzero(dense.any(axis=0))
                dense = dense[:, some]
                high = dense @ table[some] * UNIT
                low = high - ((dense > 0).astype(float) @ table[some]) * (UNIT - 1)
                best.see(row[lo:hi], low, high)
        item, row, low, high = best.rest()
        for lo in range(0, len(item), 10_000):
            part = slice(lo, lo + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[item[part]]), pa.array(row[part]), pa.array(low[part].astype(np.int64)), pa.array(high[part].astype(np.int64))], ["item", "row", "low", "high"])

    return index.levels.select("row", "terms", "impacts").mapInArrow(rows, "item long, row long, low long, high long")


def top_documents(index: Index, items: Items, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0; equal scores by rising doc_id, null ids last."""
    spark = index.levels.sparkSession
    found = checkpointed(bounds(index, items, k))
    lows = found.withColumn("q_place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low"), "row"))).where(F.col("q_place") <= k)
    least = lows.groupBy("item").agg(F.when(F.count(F.lit(1)) >= k, F.min("low")).otherwise(0).alias("least"))  # a row per item of the block
    left = checkpointed(found.join(F.broadcast(least), "item").where("high >= least").select("item", "row"))
    rows = [(key, item_id, {int(p): int(index.weights[p] * n) for p, n in zip(*asked, strict=True)}) for key, item_id, asked in zip(items.keys, items.ids, items.asked, strict=True)]
    asked = spark.createDataFrame(rows, "item long, item_id long, q_weights map<int, long>")
    exact = join_small(index.levels.select("row", "doc_id", "n_terms", "terms", "tfs"), left, "row").join(F.broadcast(asked), "item")
    m = F.expr(f"{100 - LENGTH_SHARE}L + ({LENGTH_SHARE}L * n_terms * {index.docs}L) div {max(index.length, 1)}L")
    score = F.expr(f"aggregate(filter(arrays_zip(terms, tfs), x -> map_contains_key(q_weights, x.terms)), 0L, (s, x) -> s + q_weights[x.terms] * (({SCALE}L * x.tfs) div ({TF_PART}L * x.tfs + {LENGTH_PART}L * q_m)))")
    exact = exact.withColumn("q_m", m).select("item", "item_id", "doc_id", score.alias("score")).where("score > 0")
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score over all docs (doc_id, text) for every row of items (item_id, text).

    Items come to the driver block by block; a block's terms go to every task, and each block takes its own index. Null and
    empty texts have no terms: as documents they count for nothing, as items they find nothing. Each row is a document or an
    item of its own, also if ids repeat. Empty tables give no rows.
    """
    spark, parts, rows = docs.sparkSession, [], []
    for key, r in enumerate(items.select("item_id", "text").toLocalIterator()):
        rows.append((key, r[0], r[1]))
        if len(rows) == block:
            parts.append(_block(docs, Items.of(rows), k))
            rows = []
    if rows or not parts:
        parts.append(_block(docs, Items.of(rows), k))
    if len(parts) == 1:
        return parts[0]
    parts = [materialised(p) for p in parts]
    return spark.read.parquet(*[f for p in parts for f in p.inputFiles()])


def _block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    return top_documents(build(docs, items.terms), items, k)


ORACLE = rf"""
WITH t AS (SELECT 'd' AS side, row_number() OVER () AS rid, doc_id AS id, text FROM documents UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT side, rid, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t),
p AS (SELECT *, sum(tf) OVER (PARTITION BY rid)::BIGINT AS n FROM (SELECT rid, id, term, count(*) AS tf FROM w WHERE side = 'd' GROUP BY rid, id, term)),
c AS (SELECT count(DISTINCT rid) AS docs, sum(tf)::BIGINT AS length FROM p),
df AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * n + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS n FROM p GROUP BY term), c),
a AS (SELECT rid, id, term, count(*) AS repeats FROM w WHERE side = 'i' GROUP BY rid, id, term),
s AS (SELECT a.rid, a.id AS item_id, p.rid AS doc, p.id AS doc_id, sum(repeats * df.w * (({SCALE} * tf) // ({TF_PART} * tf + {LENGTH_PART} * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // length))))::BIGINT AS score
  FROM a JOIN df USING (term) JOIN p USING (term), c GROUP BY a.rid, a.id, p.rid, p.id),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= {K}
"""
