"""Exact similarity join of word n-gram sets by PartEnum signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np

from docquarry.llm.bytewords import Texts, mix

#: Sizes in a band span this factor. Wider bands give fewer documents a second band, but coarser partitions.
BAND = 1.3
#: Each of the n1 first-level partitions is split in N2; signatures leave out one of them.
N2 = 3


@dataclass(frozen=True)
class Scheme:
    """Sets link when den * |a & b| >= num * |a | b|.

    Two such sets whose sizes are at most r differ in at most k = floor(2 r (den - num) / (den + num)) elements. Of
    n1 = k // 2 + 1 + spare partitions of the element domain, more than spare hold at most one difference, and of such a partition's
    N2 = 3 parts, two agree: the signature over those two is shared. A set gives 3 n1 signatures for its size band, and as
    many for the next band if a partner may lie there.

    Two parts without elements tell nothing and are left out. While at most spare of a set's partitions have such a
    pair, one of the agreeing partitions still has none. A set with more is irregular, and gives its empty pairs too, each along
    with every signature of a second, independent partition; two irregular sets agree in one of those, and a regular set
    shares a full signature with any partner.
    """

    num: int = 85
    den: int = 100
    lows: list[int] = field(default_factory=lambda: [1])

    def __hash__(self) -> int:
        return hash((self.num, self.den))

    def bands(self, size: int) -> list[tuple[int, int]]:
        """(band, k) for the bands in which a set of this size takes part."""
        while self.lows[-1] <= size * self.den // self.num + 1:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND) + 1))
        i = int(np.searchsorted(self.lows, size, "right")) - 1
        last = i + 1 if size * self.den // self.num >= self.lows[i + 1] else i
        if last > i and len(self.lows) < last + 2:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * BAND) + 1))
        return [(b, 2 * (self.lows[b + 1] - 1) * (self.den - self.num) // (self.den + self.num)) for b in range(i, last + 1)]

    def spare(self, band: int, n1: int) -> int:
        """Partitions beyond n1: about as many as have an empty pair in the band's smallest sets, and two deviations."""
        if n1 < 8:
            return 0
        least, extra = self.lows[band] * self.num / self.den, 0.0
        for _ in range(4):
            mean = N2 * (n1 + extra) * math.exp(-least * (N2 - 1) / N2 / (n1 + extra))
            extra = mean + 2 * math.sqrt(mean)
        return math.ceil(extra)

    def signatures(self, items: np.ndarray) -> np.ndarray:
        """64-bit signatures of a set of hashes, given sorted."""
        out = []
        for band, k in self.bands(len(items)):
            if k == 0:
                out.append(mix(np.array([items.sum(dtype=np.uint64) + np.uint64(band)])))
                continue
            n1 = k // 2 + 1
            spare = self.spare(band, n1)
            keys, empty = _parts(items, n1 + spare, band)
            out.append(keys[~empty])
            if empty.reshape(-1, N2).any(1).sum() > spare:
                other, _ = _parts(np.sort(mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5))), n1, band + 4096)
                out.append(mix(keys[empty][:, None] ^ (other * np.uint64(3))[None, :]).ravel())
        return np.concatenate(out)


def _parts(items: np.ndarray, n1: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, whether it covers no element) of each choice of two parts in each of n1 partitions."""
    cells = N2 * n1
    # the cell is monotone in the hash, so each cell is a run of the sorted hashes
    cuts = np.searchsorted(items, _edges(cells))
    sums = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(mix(items), out=sums[1:])
    sums, counts = sums[cuts[1:]] - sums[cuts[:-1]], np.diff(cuts)
    sums, counts = sums.reshape(n1, N2), counts.reshape(n1, N2)
    keys = (sums.sum(1, dtype=np.uint64)[:, None] - sums).ravel()
    empty = (counts.sum(1)[:, None] - counts).ravel() == 0
    return mix(keys ^ _labels(cells, band)), empty


@cache
def _edges(cells: int) -> np.ndarray:
    return np.array([(i << 64) // cells for i in range(cells)] + [(1 << 64) - 1], np.uint64)


@cache
def _labels(cells: int, band: int) -> np.ndarray:
    return mix(np.arange(cells, dtype=np.uint64) + np.uint64(band << 32))


def sets(t: Texts, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text: the whole sequence where there are fewer words, none without."""
    at, grams = t.ngrams(n)
    cuts = np.searchsorted(at, t.first)
    sizes = t.n_words
    out = [np.unique(grams[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    for i, h in zip(short, t.whole(short), strict=True):
        out[i] = np.array([h])
    return out


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def most_apart(sizes: int | np.ndarray, num: int, den: int):
    """How many elements two linked sets with these sizes in sum can differ in."""
    return sizes * (den - num) // (den + num)


def sketch(items: np.ndarray, k: int) -> bytes:
    """Parities of the numbers of elements in 2**j cells: differing bits never outnumber differing elements."""
    bits = 1 << min(13, max(8, (16 * k).bit_length()))
    return np.packbits((np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, at the smallest one's number of cells."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), np.uint64)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, np.uint64)
        while len(x) > least // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


_BLOCK = 512


def near_pairs(sizes: np.ndarray, sketches: list[bytes], groups: np.ndarray, halves: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) from different groups that sizes and sketches don't rule out, and how far below the bound each stays.

    Where rows are of two halves, pairs lie across them, else anywhere. Rows are taken by size, and a block of them is compared with
    a block at a time, at the smaller of their sketches' numbers of cells and word by word, so memory does not grow with the rows.
    """
    order = np.argsort(sizes, kind="stable")
    near = halves[order] == halves.min()
    first, second = order[near], order[~near]
    alone = not len(second)
    if alone:
        second = first
    for i in range(0, len(first), _BLOCK):
        a = first[i : i + _BLOCK]
        for j in range(i if alone else 0, len(second), _BLOCK):
            b = second[j : j + _BLOCK]
            if sizes[a[-1]] * den < sizes[b[0]] * num or sizes[b[-1]] * den < sizes[a[0]] * num:
                continue
            x = folded([sketches[k] for k in (*a, *b)])
            apart = np.zeros((len(a), len(b)), np.uint32)
            for left, right in zip(x[: len(a)].T, x[len(a) :].T, strict=True):
                apart += np.bitwise_count(left[:, None] ^ right[None, :])
            x, y = sizes[a, None], sizes[None, b]
            most = most_apart(x + y, num, den)
            ok = (apart <= most) & (np.minimum(x, y) * den >= np.maximum(x, y) * num) & (groups[a, None] != groups[None, b])
            if alone and i == j:
                ok &= np.tri(*ok.shape, -1, dtype=bool).T
            p, q = np.nonzero(ok)
            if len(p):
                yield a[p], b[q], (most - apart)[p, q].astype(np.int32)


def forest(groups: np.ndarray, i: np.ndarray, j: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Which of the pairs join all groups that pairs connect, those with the most slack first: a spanning forest in rounds."""
    _, root = np.unique(groups, return_inverse=True)
    parent = list(range(int(root.max()) + 1 if len(root) else 0))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges, chosen = np.arange(len(i)), []
    label = root.copy()
    while len(edges := edges[label[i[edges]] != label[j[edges]]]):
        ends, own = np.concatenate([label[i[edges]], label[j[edges]]]), np.concatenate([edges, edges])
        order = np.lexsort((own, -slack[own], ends))
        first = np.flatnonzero(np.r_[True, ends[order][1:] != ends[order][:-1]])
        for e in np.unique(own[order][first]).tolist():
            a, b = top(int(root[i[e]])), top(int(root[j[e]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                chosen.append(e)
        label = np.array([top(x) for x in range(len(parent))])[root]
    return np.array(chosen, np.int64)
