"""Nearest vectors by cosine, through an index of cells: exact by bounds, or approximate by probing the nearest cells only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.topk import NO_ID, TopK
from docquarry.runtime import materialised, ship, spread

#: Rows that the cells are fitted on: those with the smallest hashes of their ids. Every row is indexed.
SAMPLE = 20_000
MOST_CELLS, ROUNDS = 1024, 12
#: Rows of the sample by which the number of probes is chosen.
TRIALS = 500
#: Queries that are searched together.
BLOCK = 2000
#: Scores made at once.
SCORES = 1 << 21


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the rows that have a direction: no null, no nulls inside, no zero vector."""
    rows = column.to_pylist()
    at = [i for i, v in enumerate(rows) if v and None not in v]
    if not at:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    v = np.array([rows[i] for i in at], float)
    length = np.sqrt((v * v).sum(axis=1))
    some = (length > 0) & np.isfinite(length)
    return np.array(at)[some], v[some] / length[some, None]


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of cells by spherical k-means. The first centre is the first row, each next one the row farthest from those before; empty cells keep their centre."""
    centres = np.empty((cells, sample.shape[1]))
    near = np.full(len(sample), -2.0)
    at = 0
    for i in range(cells):
        centres[i] = sample[at]
        near = np.maximum(near, sample @ centres[i])
        at = int(near.argmin())
    for _ in range(rounds):
        cell = (sample @ centres.T).argmax(axis=1)
        for i in range(cells):
            mean = sample[cell == i].sum(axis=0)
            if (length := np.sqrt(mean @ mean)) > 0:
                centres[i] = mean / length
    return centres


@dataclass
class VectorIndex:
    """cells: id, cell, v (unit vector) of every row with a direction, dealt and sorted by cell; centres; widest: each cell's largest angle from its centre."""

    cells: DataFrame
    centres: np.ndarray
    widest: np.ndarray
    rows: int
    sample: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, cells: int | None = None) -> VectorIndex:
        """vectors: id, embedding. One pass assigns cells; a cell with very many rows spreads over several tasks, as rows are dealt by (cell, id)."""
        ship(vectors.sparkSession)
        vectors = vectors.select("id", "embedding")
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toArrow()
        _, sample = unit_rows(sample.column(0).combine_chunks()) if sample.num_rows else (None, np.zeros((0, 0)))
        count = vectors.count()
        if not len(sample):
            return VectorIndex(vectors.select("id", F.lit(0).alias("cell"), F.array().cast("array<double>").alias("v")).limit(0), np.zeros((0, 0)), np.zeros(0), 0, sample)
        centres = fit(sample, min(len(sample), cells or max(1, min(MOST_CELLS, round(count**0.5)))))

        def assign(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                at, v = unit_rows(b.column(1))
                if not len(at):
                    continue
                near = v @ centres.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(v)), cell], -1, 1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array(angle), lists], ["id", "cell", "angle", "v"])

        dealt = spread(vectors).mapInArrow(assign, "id long, cell int, angle double, v array<double>")
        table = materialised(dealt.repartitionByRange("cell", "id").sortWithinPartitions("cell"))
        widest, rows = np.zeros(len(centres)), 0
        for r in table.groupBy("cell").agg(F.max("angle"), F.count(F.lit(1))).collect():  # a row per cell
            widest[r[0]], rows = r[1], rows + r[2]
        return VectorIndex(table.select("id", "cell", "v"), centres, widest, rows, sample)

    def probes_for(self, k: int, least: float = 0.95) -> int:
        """The fewest cells to probe so that the sample's first TRIALS rows find that share of their k nearest rows of the sample."""
        if not len(self.centres):
            return 1
        q = self.sample[:TRIALS]
        scores = q @ self.sample.T
        np.fill_diagonal(scores, -2)
        k = max(1, min(k, len(self.sample) - 1))
        nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        cell = (self.sample @ self.centres.T).argmax(axis=1)
        place = (-(q @ self.centres.T)).argsort(axis=1).argsort(axis=1)
        needed = np.sort(np.take_along_axis(place, cell[nearest], axis=1), axis=None) + 1
        return int(needed[min(len(needed) - 1, int(np.ceil(least * len(needed))))])

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None, digits: int = 5) -> DataFrame:
        """queries: id, embedding. query, id, n, score: each query's k rows of highest cosine, itself (by id) left out; ties in the rounded score keep the smaller id.

        Without probes the result is exact: a task skips a cell for a query once the cell's widest angle tells that none of its
        rows reaches the kth best so far. With probes only that many cells, the nearest to the query, are looked into. No
        pair of row and query leaves its task but the k best. Rows without a direction neither find nor are found.
        """
        spark, parts, rows = self.cells.sparkSession, [], []
        for r in queries.select("id", "embedding").toLocalIterator():
            rows.append((r[0], r[1]))
            if len(rows) == BLOCK:
                parts.append(materialised(self._block(rows, k, probes, digits)))
                rows = []
        if not parts:
            return self._block(rows, k, probes, digits)
        if rows:
            parts.append(materialised(self._block(rows, k, probes, digits)))
        return spark.read.schema(parts[0].schema).parquet(*[f for p in parts for f in p.inputFiles()])

    def _block(self, rows: list[tuple], k: int, probes: int | None, digits: int) -> DataFrame:
        at, q = unit_rows(pa.array([r[1] for r in rows], pa.list_(pa.float64())))
        own = np.array([NO_ID if rows[i][0] is None else rows[i][0] for i in at], np.int64)
        schema = "query long, id long, score double"
        if not len(at) or not len(self.centres):
            return self.cells.sparkSession.createDataFrame([], "query long, id long, n int, score double")
        centres, widest = self.centres, self.widest
        near = q @ centres.T
        asked = np.ones(near.shape, bool)
        if probes and probes < len(centres):
            asked[:] = False
            np.put_along_axis(asked, np.argpartition(-near, probes - 1, axis=1)[:, :probes], True, axis=1)
        best = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - widest, 0)) + 10.0**-digits  # of any row of the cell, rounding included

        def score(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = TopK(len(own), k)
            for b in it:
                cell, ids = b.column(1).to_numpy(), b.column(0).fill_null(NO_ID).to_numpy()
                v = b.column(2).flatten().to_numpy().reshape(len(b), -1)
                for c in np.unique(cell).tolist():
                    mine = np.flatnonzero(cell == c)
                    for lo in range(0, len(mine), max(1, SCORES // len(own))):
                        part = mine[lo : lo + max(1, SCORES // len(own))]
                        some = np.flatnonzero(asked[:, c] & kept.wants(shifted(best[:, c])))
                        scores = np.round(v[part] @ q[some].T, digits)
                        open_ = (~kept.full[some] | (shifted(scores) >= kept.least[some])) & (ids[part][:, None] != own[some])
                        row, which = np.nonzero(open_)
                        kept.see(ids[part][row], some[which], shifted(scores[row, which]))
            query, ids, scores, _ = kept.rest()
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(ids, mask=ids == NO_ID), pa.array(np.round(scores - 2, digits))], ["query", "id", "score"])

        found = self.cells.where(F.col("cell").isin(np.flatnonzero(asked.any(axis=0)).tolist())) if not asked.any(axis=0).all() else self.cells
        found = found.mapInArrow(score, schema)
        ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("n") <= k)
        return ranked.select("query", "id", "n", "score")


def shifted(x: np.ndarray) -> np.ndarray:
    """Cosines above zero, as TopK takes them."""
    return x + 2


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    want = exact.count()
    return exact.select("query", "id").join(found.select("query", "id"), ["query", "id"], "left_semi").count() / want if want else 1.0
