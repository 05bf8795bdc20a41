"""Periodic runs of words: stretches that repeat a short period, found by divide and conquer at the texts' midpoints.

A run has a smallest period q, LEAST_WORDS words and LEAST_TIMES periods at least, and no neighbouring word extends it.
It crosses the midpoint of exactly one segment of the halving that holds it whole. There, half of it lies on one side, so
the q words next to the midpoint come twice on that side: the Z-function from the midpoint tells every such q, and
the other side is extended by comparing words at distance q (Main and Lorentz).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.bytewords import chunks, running
from docquarry.runtime import ship

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words compared for many midpoints at once before a midpoint's Z-function is made.
_GLANCE = 8
RUNS = "array<struct<start: long, length: long, period: long>>"
WORD = r"[^\x20\x09-\x0D]+"


def z_function(s: list) -> list[int]:
    """For each i the length of the longest common prefix of s and s[i:]."""
    n = len(s)
    z = [n] * min(n, 1) + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def squares(z: list[int]) -> Iterator[int]:
    """Periods p, rising, whose first p words come twice. Within the reach of a shorter period there are only its multiples, which give the same run."""
    reach = 0
    for p in range(1, len(z) // 2 + 1):
        if z[p] >= max(p, LEAST_WORDS // 2 - p) and 2 * p > reach:
            reach = max(reach, p + z[p])
            yield p


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many first words of a and b are equal."""
    differ = a != b
    k = int(differ.argmax()) if len(differ) else 0
    return k if len(differ) and differ[k] else len(differ)


def crossing(ids: np.ndarray, lo: int, mid: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions around mid, as far as they go within [lo, hi)."""
    z = z_function(ids[mid:hi].tolist())
    for p in squares(z):
        back = _agree(ids[lo:mid][::-1], ids[lo + p : mid + p][::-1])
        yield mid - back, mid + p + z[p], p
    z = z_function(ids[lo:mid][::-1].tolist())
    for p in squares(z):
        yield mid - p - z[p], mid + _agree(ids[mid:hi], ids[mid - p : hi - p]), p


def _busy(ids: np.ndarray, head: np.ndarray, step: int, room: np.ndarray) -> np.ndarray:
    """Which midpoints may have a word sequence twice in a row, from the word at head onwards (step 1) or backwards (-1), by the first words."""
    half = room // 2
    total = running(half)
    seg = np.repeat(np.arange(len(head)), half)
    q = np.arange(1, total[-1] + 1) - total[seg]
    at = np.flatnonzero(ids[head[seg] + step * q] == ids[head][seg])
    seg, q = seg[at], q[at]
    need = np.maximum(LEAST_WORDS // 2, 2 * q)
    fits = need <= room[seg]
    seg, q, need = seg[fits], q[fits], need[fits]
    for k in range(1, _GLANCE):
        first = head[seg] + step * np.minimum(k, need - q - 1)
        same = ids[first] == ids[first + step * q]
        seg, q, need = seg[same], q[same], need[same]
    out = np.zeros(len(head), bool)
    out[seg] = True
    return out


def runs_of(ids: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For texts with words ids[first[i]:first[i + 1]], the runs (start, length, period) by start, then period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in first[:-1]]
    text, lo, hi = np.arange(len(first) - 1), first[:-1], first[1:]
    while True:
        wide = hi - lo >= LEAST_WORDS
        text, lo, hi = text[wide], lo[wide], hi[wide]
        if not len(text):
            break
        mid = (lo + hi) // 2
        for s in np.flatnonzero(_busy(ids, mid, 1, hi - mid) | _busy(ids, mid - 1, -1, mid - lo)).tolist():
            d, a, b = int(text[s]), int(lo[s]), int(hi[s])
            for start, end, p in crossing(ids, a, int(mid[s]), b):
                longer = (start == a > first[d] and ids[a - 1] == ids[a - 1 + p]) or (end == b < first[d + 1] and ids[b] == ids[b - p])
                if not longer and end - start >= max(LEAST_WORDS, LEAST_TIMES * p):  # a longer one is found whole in a wider segment
                    key = (start - int(first[d]), end - start)
                    found[d][key] = min(p, found[d].get(key, p))
        text, lo, hi = np.concatenate([text, text]), np.concatenate([lo, mid]), np.concatenate([mid, hi])
    return [sorted((start, n, p) for (start, n), p in f.items()) for f in found]


def collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that any run holds after its first period."""
    words = text.split()  # on 20, 09 to 0D hex
    if runs:
        kept = np.ones(len(words), bool)
        for start, n, p in runs:
            kept[start + p : start + n] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period by start, then period), collapsed (the text without repeated periods).

    One pass without a shuffle, some 1.5 MB of texts or one longer text at a time. Words are interned by 64-bit hashes. Null
    or empty text: no runs and an empty collapsed text; null ids and repeated rows give a row each, an empty table none.
    """
    ship(docs.sparkSession)

    def rows(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, t in chunks(batch.column(1), lower=False):
                ids = np.unique(t.hashes, return_inverse=True)[1].astype(np.int32)
                found = runs_of(ids, t.first)
                flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
                runs = pa.ListArray.from_arrays(pa.array(running(np.array([len(f) for f in found], np.int32)).astype(np.int32)), pa.StructArray.from_arrays([flat[:, 0], flat[:, 1], flat[:, 2]], ["start", "length", "period"]))
                texts = [collapsed(t.data[a:b].tobytes(), f) for a, b, f in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(t.n_words), runs, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id, text; every tenth document, by h = crc32(doc_id), ends in a loop: from word a on, its words are the p words from a over and over.

    With g = h div 10 and n words, a = g % n and p = 1 + (n - a) div (3 + g % 8). Null ids are left as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", (h % 10 == 0).alias("q_loop"), F.floor(h / 10).cast("long").alias("q_g"))
    g = F.col("q_g")

    def loop(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        return F.array_join(F.concat(F.slice(ws, 1, a), F.slice(F.flatten(F.array_repeat(F.slice(ws, a + 1, p), times)), 1, n - a)), " ")

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    edited = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, loop(ws)).otherwise(""))[0]  # the words are taken once
    return docs.select("doc_id", F.when(F.col("q_loop"), edited).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per row of docs, edited by looped(): doc_id, n_runs; start, length, period and exponent_milli of the run with the greatest length / period; digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("times"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = find_runs(looped(docs)).withColumn("q_best", best)
    length, period = F.col("q_best.length"), -F.col("q_best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("q_best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
