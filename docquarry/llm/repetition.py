"""Quality rules on repetition: how much of a text lies in repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm.bytewords import Texts, chunks, mix, per_text, repeated, running
from docquarry.runtime import ship, tidied

LENGTHS = (5, 6, 7, 8, 9, 10)
#: Share of a text's word characters that may lie in repeated n-grams of each length, and in repeated lines.
MOST_NGRAM = (0.40, 0.38, 0.36, 0.34, 0.32, 0.30)
MOST_LINES = 0.40
#: The base rules.
MIN_WORDS, BASE_WINDOW, MOST_REPEATED = 20, 8, 30
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def measure(t: Texts, lengths: Sequence[int]) -> dict[str, np.ndarray]:
    """Arrays with an entry per text: the base counts, and characters in repeated lines and n-grams (dup_N)."""
    n_texts = len(t.bounds) - 1
    points = running(((t.data & 0xC0) != 0x80).astype(np.int64))
    chars = points[t.ends] - points[t.starts]
    char_sums = running(chars)
    salt = mix(np.arange(1, n_texts + 1, dtype=np.uint64))
    text = np.repeat(np.arange(n_texts), t.n_words)

    breaks = np.flatnonzero(t.data == 10)
    starts = np.sort(np.concatenate([t.bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, t.bounds[1:]]), kind="stable")
    a, b = np.searchsorted(t.starts, starts), np.searchsorted(t.starts, ends)
    full = b > a
    starts, ends, a, b = starts[full], ends[full], a[full], b[full]
    line_text = text[a]
    again = repeated(t.run_hash(starts, ends) ^ salt[line_text], later=True)
    lines = char_sums[b] - char_sums[a]

    out = {
        "n_words": t.n_words, "word_chars": per_text(char_sums, t.first), "n_symbols": per_text(running(_SYMBOLS[t.data].astype(np.int64)), t.bounds),
        "n_dup_lines": np.bincount(line_text[again], minlength=n_texts), "dup_line_chars": np.bincount(line_text[again], lines[again], n_texts).astype(np.int64),
    }
    for n in sorted({*lengths, BASE_WINDOW}):
        at, grams = t.ngrams(n)
        at = at[repeated(grams ^ salt[text[at]])]
        inside = np.zeros(len(chars) + 1, np.int64)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + n, -1)
        covered = np.cumsum(inside[:-1]) > 0
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_text(running(covered.astype(np.int64)), t.first)
        if n in lengths:
            out[f"dup_{n}"] = per_text(running(np.where(covered, chars, 0)), t.first)
    return out


def judge(m: dict[str, np.ndarray], lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    bad = m["dup_line_chars"] > MOST_LINES * m["word_chars"]
    for n, most in zip(lengths, MOST_NGRAM, strict=True):
        bad = bad | (m[f"dup_{n}"] > most * m["word_chars"])
    return failed, ~(failed | bad)


def coverage(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept, dup_line_chars and dup_5 to dup_10 (characters).

    kept: not base_failed, and no measure above its share. Null text: no words, so it fails. One pass without a
    shuffle; repeated rows and null ids give a row each, an empty table none.
    """
    ship(docs.sparkSession)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["dup_line_chars", *(f"dup_{n}" for n in LENGTHS)]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, t in chunks(batch.column(1), lower=False):
                m = measure(t, LENGTHS)
                failed, kept = judge(m, LENGTHS)
                cols = [pa.array(m[c].astype(np.int64)) for c in counts], [pa.array(failed), pa.array(kept)], [pa.array(m[c].astype(np.int64)) for c in more]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *sum(cols, [])], ["doc_id", *counts, "base_failed", "kept", *more])

    longs = lambda names: ", ".join(f"{c} long" for c in names)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {longs(counts)}, base_failed boolean, kept boolean, {longs(more)}")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that coverage() keeps, all columns, in one pass."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, t in chunks(batch.column(at), lower=False):
                yield batch.slice(lo, hi - lo).filter(pa.array(judge(measure(t, LENGTHS), LENGTHS)[1]))

    return docs.mapInArrow(lambda it: tidied(run(it)), docs.schema)


def _oracle() -> str:
    """coverage() in DuckDB."""
    dups = ", ".join(f"coalesce(sum(chars) FILTER (n = {n}), 0)::BIGINT AS dup_{n}" for n in LENGTHS)
    bad = " OR ".join(f"dup_{n} > {most} * word_chars" for n, most in zip(LENGTHS, MOST_NGRAM, strict=True))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, i, length(ws[i]) AS chars FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
g AS (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT unnest({sorted({*LENGTHS, BASE_WINDOW})}) AS n) WHERE len(ws) >= n)),
r AS (SELECT rid, n, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, n, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT DISTINCT rid, n, i + k AS i FROM (SELECT rid, n, i, unnest(range(0, n)) AS k FROM r)),
s AS (SELECT rid, count(*) FILTER (n = {BASE_WINDOW}) AS n_repeat_words, {dups} FROM c JOIN w USING (rid, i) GROUP BY rid),
l AS (SELECT rid, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
a AS (SELECT rid, length(array_to_string(lw, '')) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS k FROM l WHERE len(lw) > 0) WHERE k > 1),
t AS (SELECT rid, count(*) AS n_dup_lines, sum(chars)::BIGINT AS dup_line_chars FROM a GROUP BY rid),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(dup_{n}, 0) AS dup_{n}" for n in LENGTHS)} FROM d LEFT JOIN s USING (rid) LEFT JOIN t USING (rid))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words OR dup_line_chars > {MOST_LINES} * word_chars OR {bad}) AS kept FROM f
"""


ORACLE = _oracle()
