"""The k best rows of many queries within a task: what a search emits instead of every pair of row and query."""

from __future__ import annotations

import numpy as np

#: Stands for a null id, behind all others among equal scores.
NO_ID = (1 << 63) - 1


class TopK:
    """Best k rows per query by (score falling, id rising), over any number of batches; holds some k rows a query."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.least = np.zeros(queries)
        self.full = np.zeros(queries, bool)
        self.rows: list[np.ndarray] = []
        self.extra: list[np.ndarray] = []
        self.size = 0

    def wants(self, best: np.ndarray) -> np.ndarray:
        """Which queries may still take a row whose score is at most `best`."""
        return ~self.full | (best >= self.least)

    def see(self, ids: np.ndarray, query: np.ndarray, score: np.ndarray, extra: np.ndarray | None = None) -> None:
        """Rows as aligned arrays; extra: further columns (n x m), carried along."""
        take = ~self.full[query] | (score >= self.least[query])
        self.rows.append(np.rec.fromarrays([query[take], -score[take], ids[take]], names="q,s,id"))
        self.extra.append(np.zeros((int(take.sum()), 0)) if extra is None else extra[take])
        self.size += int(take.sum())
        if self.size > 4 * self.k * self.queries + 1000:
            self.cut()

    def cut(self) -> None:
        rows, extra = np.concatenate(self.rows), np.concatenate(self.extra)
        order = np.lexsort((rows["id"], rows["s"], rows["q"]))
        rows, extra = rows[order], extra[order]
        first = np.searchsorted(rows["q"], np.arange(self.queries))
        place = np.arange(len(rows)) - first[rows["q"]]
        last = rows[place == self.k - 1]
        self.least[last["q"]], self.full[last["q"]] = -last["s"], True
        keep = place < self.k
        self.rows, self.extra, self.size = [rows[keep]], [extra[keep]], int(keep.sum())

    def rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score, extra) of the best rows, by query and rank."""
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0))
        self.cut()
        rows = self.rows[0]
        return rows["q"], rows["id"], -rows["s"], self.extra[0]
