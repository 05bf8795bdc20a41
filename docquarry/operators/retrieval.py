"""Hybrid lexical retrieval: binary-frequency BM25, Jaccard and a hashed-vector cosine.

Queries come in blocks and meet every document's row inside a task, so that no pair of document and query is ever
shuffled: a first pass keeps each document's tokens that the block asks for, its number of tokens and its hashed vector; a second
one finds the best BM25 of each query, by which scores are scaled; a third one scores, and each task emits its k best documents a query.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators.topk import NO_ID, TopK
from docquarry.runtime import materialised, ship, spread

K1, B = 1.5, 0.75
WEIGHTS = {"bm25": 0.70, "lexical": 0.20, "vector": 0.10}
LEAST_VECTOR = 0.18
DIMS = 128
#: Queries that are searched together.
BLOCK = 1000
#: (document, token, query) triples that a task adds up at once.
TRIPLES = 2_000_000
#: Tokens whose names a task remembers.
NAMES = 300_000
_SPACES = re.compile("[ \t\n\x0b\f\r]+")
_PARTED = str.maketrans(T.SEPARATORS, " " * len(T.SEPARATORS))


class Names(dict):
    """A token's 64-bit name: the second half of its MD5, so that its low bits are the token's place in the hashed vector. Short tokens are remembered."""

    def __missing__(self, token: str) -> int:
        name = int.from_bytes(hashlib.md5(token.encode()).digest()[8:], "big")
        if len(token) <= 4:
            if len(self) > NAMES:
                self.clear()
            self[token] = name
        return name


def tokenizer() -> Callable[[str | None], np.ndarray]:
    """The names of a text's distinct tokens (its words and their parts of 2 to 4 characters), rising."""
    names = Names()

    def tokens(text: str | None) -> np.ndarray:
        words = {w for w in _SPACES.split((text or "").translate(_PARTED)) if w}
        parts = {w[i : i + n] for w in words for n in (2, 3, 4) for i in range(len(w) - n + 1)} | words
        return np.sort(np.fromiter(map(names.__getitem__, parts), np.uint64, len(parts)))

    return tokens


def hashed(names: np.ndarray) -> np.ndarray:
    return np.bincount((names & np.uint64(DIMS - 1)).astype(np.int64), minlength=DIMS)


@dataclass
class Queries:
    """A block of queries: ids, the tokens of all (sorted names), the queries of each token (of[at[t]:at[t + 1]]), sizes and unit vectors."""

    ids: list
    names: np.ndarray
    at: np.ndarray
    of: np.ndarray
    sizes: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def block(rows: list[tuple]) -> Queries:
        tokens = tokenizer()
        found = [tokens(text) for _, text in rows]
        names, token = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_inverse=True)
        query = np.repeat(np.arange(len(rows)), [len(f) for f in found])
        order = np.argsort(token, kind="stable")
        at = np.searchsorted(token[order], np.arange(len(names) + 1))
        return Queries([r[0] for r in rows], names, at, query[order], np.array([len(f) for f in found], np.int64), unit(np.array([hashed(f) for f in found], float).reshape(-1, DIMS)))


def unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def rounded(x: np.ndarray) -> np.ndarray:
    """To four places, halves up."""
    return np.floor(x * 1e4 + 0.5) / 1e4


def features(docs: DataFrame, names: np.ndarray) -> DataFrame:
    """doc_id, size (distinct tokens), tokens (places in names, rising), vector (DIMS 32-bit counts): a row per document, without a shuffle."""
    ship(docs.sparkSession)

    def rows(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer()
        for b in it:
            sizes, places, vectors = [], [], []
            for text in b.column(1).to_pylist():
                own = tokens(text)
                at = np.searchsorted(names, own)
                at = at[at < len(names)]  # both rise
                sizes.append(len(own))
                places.append(at[names[at] == own[: len(at)]])
                vectors.append(hashed(own).astype("<i4").tobytes())
            ends = np.cumsum([0, *map(len, places)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*places, np.zeros(0, int)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), lists, pa.array(vectors, pa.binary())], ["doc_id", "size", "tokens", "vector"])

    return docs.mapInArrow(rows, "doc_id long, size int, tokens array<int>, vector binary")


def shared(b: pa.RecordBatch, q: Queries, idf: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, number of common tokens, sum of their idf), the latter as documents x queries, some rows at a time."""
    column = b.column(2)
    ends, token = column.offsets.to_numpy().astype(np.int64), column.flatten().to_numpy()
    ends = ends - ends[0]
    met = q.at[token + 1] - q.at[token] if len(token) else np.zeros(0, np.int64)
    triples = np.concatenate([[0], np.cumsum(met)])[ends]
    lo, n = 0, len(q.ids)
    while lo < len(b):
        hi = max(lo + 1, int(np.searchsorted(triples, triples[lo] + TRIPLES)) - 1)
        hi = min(hi, lo + max(1, TRIPLES // n), len(b))
        part = slice(ends[lo], ends[hi])
        t, m = token[part], met[part]
        doc = np.repeat(np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])), m)
        which = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(q.at[t], m)
        cell = doc * n + q.of[which]
        yield lo, hi, np.bincount(cell, minlength=(hi - lo) * n).reshape(hi - lo, n), np.bincount(cell, np.repeat(idf[t], m), (hi - lo) * n).reshape(hi - lo, n)
        lo = hi


def rank_block(docs: DataFrame, q: Queries, k: int) -> DataFrame:
    spark = docs.sparkSession
    table = materialised(features(spread(docs), q.names))
    n, mean = table.agg(F.count(F.lit(1)), F.avg("size")).first()
    mean = max(mean or 0.0, 1.0)
    df = np.zeros(len(q.names))
    for token, count in table.select(F.explode("tokens").alias("token")).groupBy("token").count().collect():  # a row per token of the block
        df[token] = count
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    share = lambda sizes: (K1 + 1) / (1 + K1 * (1 - B + B * sizes / mean))

    def best(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(len(q.ids))
        for b in it:
            for lo, hi, _, sums in shared(b, q, idf):
                top = np.maximum(top, (sums * share(b.column(1).to_numpy()[lo:hi])[:, None]).max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(top))), pa.array(top)], ["q", "top"])

    top = np.zeros(len(q.ids))
    for i, x in table.mapInArrow(best, "q long, top double").groupBy("q").agg(F.max("top")).collect():  # a row per query of the block
        top[i] = x
    scale = np.where(top > 0, top, 1.0)

    def score(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = TopK(len(q.ids), k)
        for b in it:
            ids = b.column(0).fill_null(NO_ID).to_numpy()
            sizes = b.column(1).to_numpy()
            vectors = unit(np.frombuffer(b"".join(b.column(3).to_pylist()), "<i4").reshape(-1, DIMS).astype(float))
            for lo, hi, both, sums in shared(b, q, idf):
                bm25 = sums * share(sizes[lo:hi])[:, None] / scale
                lexical = both / np.maximum(sizes[lo:hi, None] + q.sizes - both, 1)
                vector = vectors[lo:hi] @ q.vectors.T
                hybrid = rounded(WEIGHTS["bm25"] * bm25 + WEIGHTS["lexical"] * lexical + WEIGHTS["vector"] * vector)
                doc, query = np.nonzero((hybrid > 0) & ((bm25 > 0) | (lexical > 0) | (vector >= LEAST_VECTOR)) & (~kept.full | (hybrid >= kept.least)))
                kept.see(ids[lo:hi][doc], query, hybrid[doc, query], np.stack([x[doc, query] for x in (bm25, lexical, vector)], axis=1))
        query, ids, hybrid, parts = kept.rest()
        if len(ids):
            parts = rounded(parts)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids, mask=ids == NO_ID), pa.array(hybrid), *(pa.array(parts[:, i]) for i in range(3))], ["q", "doc_id", "hybrid", *WEIGHTS])

    found = table.mapInArrow(score, "q long, doc_id long, hybrid double, bm25 double, lexical double, vector double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("hybrid"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(q.ids)), "q long, query_id long"))
    return ranked.join(names, "q").select("query_id", "doc_id", "rank", "hybrid", *WEIGHTS)


def hybrid_rank(queries: DataFrame, docs: DataFrame, k: int = 8, text: Column | None = None, block: int = BLOCK) -> DataFrame:
    """queries: query_id, query_text; docs: doc_id, text (or whatever the expression `text` makes of their columns). Top k per query: query_id, doc_id, rank, hybrid, bm25, lexical, vector.

    Exact: every document is scored, in its own task. Ties in the rounded hybrid keep the smaller doc_id, null ids last. Each
    row is a document or a query of its own; texts without tokens find nothing and are never found, but count in the mean size.
    """
    docs = docs.select("doc_id", (F.col("text") if text is None else text).alias("text"))
    parts, rows = [], []
    for r in queries.select("query_id", "query_text").toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == block:
            parts.append(materialised(rank_block(docs, Queries.block(rows), k)))
            rows = []
    if not parts and not rows:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, rank int, hybrid double, bm25 double, lexical double, vector double")
    if not parts:
        return rank_block(docs, Queries.block(rows), k)
    if rows:
        parts.append(materialised(rank_block(docs, Queries.block(rows), k)))
    return docs.sparkSession.read.schema(parts[0].schema).parquet(*[f for p in parts for f in p.inputFiles()])


ORACLE = """
WITH base AS (SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'q', item_id, coalesce(text, '') FROM benchmark),
w AS (SELECT DISTINCT side, id, unnest(string_split_regex(translate(text, ' -_/，。（）()、：:', '             '), '[ \\t\\n\\r]+')) AS w FROM base),
g AS (SELECT side, id, w AS token FROM w WHERE w <> ''
  UNION SELECT side, id, substr(w, i, n) FROM (SELECT side, id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM w, (VALUES (2), (3), (4)) AS l(n) WHERE length(w) >= n)),
s AS (SELECT side, id, count(*) AS size FROM g GROUP BY ALL),
st AS (SELECT count(*) AS n, greatest(sum(coalesce(size, 0)) / count(*), 1.0) AS mean FROM documents LEFT JOIN s ON s.side = 'd' AND s.id = doc_id),
df AS (SELECT token, count(*) AS df FROM g WHERE side = 'd' GROUP BY token),
b AS (SELECT q.id AS query_id, d.id AS doc_id, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * s.size / st.mean))) AS bm25, count(*) AS common, max(s.size) AS size, max(sq.size) AS q_size
  FROM g q JOIN g d ON q.token = d.token AND q.side = 'q' AND d.side = 'd' JOIN df ON df.token = d.token JOIN s ON s.side = 'd' AND s.id = d.id JOIN s AS sq ON sq.side = 'q' AND sq.id = q.id, st GROUP BY 1, 2),
v AS (SELECT side, id, ('0x' || right(md5(token), 2))::INT % 128 AS bucket, count(*) AS c FROM g GROUP BY ALL),
nv AS (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY side, id)) AS norm FROM v),
c AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.c * d.c) / max(d.norm) / max(q.norm) AS vector FROM nv q JOIN nv d ON q.bucket = d.bucket AND q.side = 'q' AND d.side = 'd' GROUP BY 1, 2),
f AS (SELECT query_id, doc_id, vector, coalesce(bm25, 0) / CASE WHEN max(coalesce(bm25, 0)) OVER (PARTITION BY query_id) > 0 THEN max(coalesce(bm25, 0)) OVER (PARTITION BY query_id) ELSE 1 END AS bm25, coalesce(common / (size + q_size - common), 0.0) AS lexical FROM c LEFT JOIN b USING (query_id, doc_id)),
h AS (SELECT *, round(bm25 * 0.7 + lexical * 0.2 + vector * 0.1, 4) AS hybrid FROM f WHERE bm25 > 0 OR lexical > 0 OR vector >= 0.18),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, doc_id) AS rank FROM h WHERE hybrid > 0)
SELECT query_id, doc_id, rank::INT AS rank, hybrid, round(bm25, 4) AS bm25, round(lexical, 4) AS lexical, round(vector, 4) AS vector FROM r WHERE rank <= 8
"""
