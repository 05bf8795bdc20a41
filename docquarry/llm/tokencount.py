"""Token counts by way of distinct pre-tokens: each is split into pieces once, and a document's pre-token frequencies are joined to the piece counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.heads import frequent, tallied
from docquarry.llm.tokens import as_letters, from_letters, tokenizer
from docquarry.runtime import materialised, ship

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: The most frequent pre-tokens, whose piece counts every task holds (some 30 MB); the others' are joined by a shuffle.
HEAD_PARTS = 200_000
#: The tokenizer's own pre-token pattern over the characters on whose classes all pattern libraries agree, with their letters and numbers
#: written out; texts with other characters are split by the tokenizer's splitter.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
PRETOKENS = rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"
OTHER = "[^\t\n\r -~¡-¬®-ɏ‐-‧‰-⁞₠-₿€]"
#: Stands before the number of a document's own row in the join, so that these rows spread evenly.
_OWN = "\x00row "


def splitter(name: str) -> Callable[[str | None], tuple[list[str], int]]:
    """A text's pre-tokens in order, and how many special strings stand between them (a token each)."""
    whole = tokenizer(name)
    special = sorted((t.content for t in whole.get_added_tokens_decoder().values()), key=len, reverse=True)
    cut = re.compile("|".join(map(re.escape, special))).split if special else lambda t: [t]
    marks = tuple(s[:2] for s in special)
    find, other, slow = re.compile(PRETOKENS).findall, re.compile(OTHER).search, whole.pre_tokenizer.pre_tokenize_str

    def one(text: str) -> list[str]:
        return [from_letters(p) for p, _ in slow(text)] if other(text) else find(text)

    def split(text: str | None) -> tuple[list[str], int]:
        if not text:
            return [], 0
        if not any(m in text for m in marks):
            return one(text), 0
        runs = cut(text)
        return [p for run in runs if run for p in one(run)], len(runs) - 1

    return split


def piece_counts(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """part, n, pieces: every distinct pre-token of docs, how often it occurs, and the number of its tokens, found once."""

    def parts() -> Callable[[str | None], list[str]]:
        split = splitter(name)
        return lambda t: split(t)[0]

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = tokenizer(name).model
        for b in it:
            pieces = [len(merges.tokenize(as_letters(p))) for p in b.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("n"), pa.array(pieces, pa.int64())], ["part", "n", "pieces"])

    return tallied(docs.select("text"), parts, "string").mapInArrow(count, "part string, n long, pieces long")


def token_counts(docs: DataFrame, name: str = TOKENIZER, limit: int = LIMIT, head_parts: int = HEAD_PARTS) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Null text counts as empty: 0 tokens. Repeated rows and null ids give a row each; an empty table gives none. A special
    string inside a text is one token. Of a document's pre-token frequencies, those of the most frequent pre-tokens meet
    their piece counts in a broadcast of at most head_parts entries, the others in a join; both are summed by row. Ids are
    never made, and no key of the join is frequent.
    """
    ship(docs.sparkSession)
    table = materialised(piece_counts(docs, name))
    head = frequent(table, head_parts, "pieces")
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = sent.value, splitter(name)
        row = TaskContext.get().partitionId() << 40
        for b in it:
            own, rare = [], []
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, special = split(text)
                total = special
                for p, n in Counter(found).items():
                    if (pieces := known.get(p)) is None:
                        rare.append((row, p, n, None, None, None))
                    else:
                        total += n * pieces
                own.append((row, f"{_OWN}{row}", 0, ident, len((text or "").encode()), total))
                row += 1
            cols = zip(*(own + rare), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), *[pa.int64()] * 4), strict=True)], ["row", "part", "tf", "doc_id", "n_bytes", "known"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "row long, part string, tf long, doc_id long, n_bytes long, known long")
    tokens = F.sum(F.coalesce("known", F.lit(0)) + F.col("tf") * F.coalesce("pieces", F.lit(0)))
    summed = counted.join(table.select("part", "pieces"), "part", "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
