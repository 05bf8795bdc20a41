"""Words, lines and n-grams of many texts at once, as numpy arrays over their UTF-8 bytes.

Words are runs of bytes other than white space (20, 09 to 0D hex), which never occur inside a longer UTF-8 sequence.
A run's hash is a polynomial in its bytes modulo 2**64, taken as a difference of prefix sums and then mixed; equal
runs have equal hashes, and different ones the same hash with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docquarry.llm.tokens import kept, slices

#: Bytes worked on at once.
CHUNK = 1_500_000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: a bijection with every output bit depending on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _bytes_table(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if lower:
        t[65:91] = t[97:123]
    return t


_TABLES = {False: _bytes_table(False), True: _bytes_table(True)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1 and those of its inverse, modulo 2**64."""
    box = kept("powers", lambda: [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(box[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(max(n, CHUNK + 200_000), b & _MASK, np.uint64)
            x[0] = 1
            box[k] = np.cumprod(x, dtype=np.uint64)
    return box[0][:n], box[1][:n]


def running(values: np.ndarray, first: int = 0) -> np.ndarray:
    """Prefix sums with a zero in front."""
    out = np.empty(len(values) + 1, values.dtype)
    out[0] = first
    np.cumsum(values, out=out[1:])
    return out


@dataclass
class Texts:
    """Some texts: bytes, each text's bounds in them, and its words' bounds, hashes and first word."""

    data: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def run_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * powers(len(self.sums))[1][starts])

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every n-word window, in order; the i-th word's window is missing where it would leave its text."""
        text = np.repeat(np.arange(len(self.bounds) - 1), self.n_words)
        fits = np.arange(len(self.starts)) + n <= self.first[text + 1]
        at = np.flatnonzero(fits)
        up, down = powers(len(self.hashes) + 1)
        sums = running(self.hashes * up[:-1])
        return at, mix((sums[at + n] - sums[at]) * down[at])

    def whole(self, text: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences of whole texts."""
        up, down = powers(len(self.hashes) + 1)
        sums = running(self.hashes * up[:-1])
        a, b = self.first[text], self.first[text + 1]
        return mix((sums[b] - sums[a]) * down[a])


def read(data: np.ndarray, bounds: np.ndarray, lower: bool) -> Texts:
    n = len(data)
    space = SPACE[data]
    edge = np.empty(n + 1, bool)  # a text starts here, or the byte before is white space
    edge[0], edge[1:] = True, space
    edge[bounds] = True
    word = ~space
    starts = np.flatnonzero(word & edge[:-1])
    edge[:-1] = space
    edge[bounds] = True
    ends = np.flatnonzero(word & edge[1:]) + 1
    up, _ = powers(n + 1)
    values = _TABLES[lower][data]
    values *= up[:-1]
    t = Texts(data, bounds, running(values), starts, ends, np.empty(0, np.uint64), np.searchsorted(starts, bounds))
    t.hashes = t.run_hash(starts, ends)
    return t


def chunks(column: pa.Array, lower: bool, size: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) of a string column, a bounded number of bytes at a time; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for lo, hi in slices(np.diff(offsets).tolist(), size):
        yield lo, hi, read(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower)


def per_text(sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated(keys: np.ndarray, later: bool = False) -> np.ndarray:
    """Which keys occur twice or more; later: only those after a key's first occurrence.

    Keys alone in their bucket of a counting table are unique, so that only the others are sorted.
    """
    out = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return out
    bits = np.uint64(64 - min(24, max(8, int(len(keys)).bit_length() + 2)))
    bucket = (keys >> bits).astype(np.int64)
    some = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
    order = some[np.argsort(keys[some], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = True
    if not later:
        out[order[:-1][same]] = True
    return out
