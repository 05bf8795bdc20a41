"""Packing token sequences into windows by minimum bin slack."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.operators.ranking import positions
from docquarry.llm.tokens import CACHE_ENTRIES, Remembered, as_letters, kept_for, tokenizer
from docquarry.runtime import checkpointed, ship, tidied

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
SPACES = " \t\n\x0b\x0c\r"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
#: Words and parts of words that a worker remembers, in each of two generations: some 250 bytes each.
WORDS_KEPT, PARTS_KEPT = 150_000, 50_000


#: Words of these characters are normalised, split and looked up alike by Python and the tokenizer; others are left to it, as are its special strings.
PLAIN = re.compile("[!-~¡-ÿ]+")
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_encoder(name: str, user: str = "packing", parts_kept: int = CACHE_ENTRIES) -> Callable[[str], bytes]:
    """Little-endian 32-bit ids of a white-space separated word.

    The tokenizer drops white space, its patterns never match across it and its special strings hold none, so a
    text's ids are its words' ids in order. A word's parts go straight to the tokenizer's merges and are remembered.
    """
    import regex

    whole = tokenizer(name)
    merges, parts = whole.model, regex.compile(PARTS).findall
    pieces = kept_for(user, f"parts:{name}", lambda: Remembered(lambda part: array("I", [t.id for t in merges.tokenize(as_letters(part))]).tobytes(), parts_kept))

    def encode(word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            pieces.rest()
            return b"".join([pieces[p] for p in parts(word.lower())])
        return array("I", whole.encode(word, add_special_tokens=False).ids).tobytes()

    return encode


def word_ids(name: str, user: str = "packing") -> Remembered:
    """word_encoder() with the words remembered."""
    return kept_for(user, f"word ids:{name}", lambda: Remembered(word_encoder(name, user, PARTS_KEPT), WORDS_KEPT))


def cut(batches: Iterable[pa.RecordBatch], name: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """A row per piece: full windows of a document's ids, then the rest. A document has its end id at least."""
    end = end_id.to_bytes(4, "little")
    ids_of = word_ids(name)
    for batch in batches:
        rows: list[tuple] = []
        for k, text in enumerate(batch.column(1).to_pylist()):
            ids_of.rest()
            words = SPACE.split(text.strip(SPACES)) if text else []
            ids = b"".join([ids_of[w] for w in words if w]) + end
            n = len(ids) // 4
            rows += [(k, s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
        if rows:
            at, start, length, crc, total = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc), pa.array(total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def fullest(counts: Mapping[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum of at most room, by a bitset of reachable sums.

    Bit s of a mask tells that s can be reached; each length's copies are added in powers of two, and the masks of
    each step are kept to find the counts backwards.
    """
    masks, steps = [1], []
    bound = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, power = min(counts[length], room // length), 1
        while left:
            n = min(power, left)
            masks.append((masks[-1] | masks[-1] << (n * length)) & bound)
            steps.append((length, n))
            left, power = left - n, power * 2
        if masks[-1] >> room & 1:
            break
    at = masks[-1].bit_length() - 1
    taken: dict[int, int] = {}
    for k in range(len(steps) - 1, -1, -1):
        if not masks[k] >> at & 1:
            length, n = steps[k]
            taken[length] = taken.get(length, 0) + n
            at -= n * length
    return taken


def plan(counts: Mapping[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how often in a window}) until all lengths are used up.

    Each window starts with the longest rest and is filled by fullest(); it is repeated as often as the counts
    allow, so that the work depends on the number of different lengths, not of pieces.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        first = max(left)
        left[first] -= 1
        taken = fullest(left, window - first)
        left[first] += 1
        taken[first] = taken.get(first, 0) + 1
        times = min(left[k] // v for k, v in taken.items())
        for k, v in taken.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
        out.append((times, taken))
    return out


def slots(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a window, offset in it), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, taken in patterns:
        offset = 0
        for length in sorted(taken, reverse=True):
            rows.append((length, rank.get(length, 0), sequence, taken[length], offset))
            rank[length] = rank.get(length, 0) + times * taken[length]
            offset += length * taken[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, name: str = TOKENIZER, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text: the end id alone. Longer documents give full windows and one rest. The rests' histogram (at
    most `window` counts) is all that the driver plans on; ranks within a length, gathered without a hot task, give
    each piece its place. Null ids and repeated rows are packed as they come; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    pieces = checkpointed(docs.select("doc_id", "text").mapInArrow(lambda it: tidied(cut(it, name, window, end_id)), PIECES))  # range partitioning reads its input twice
    ranked = positions(pieces, ["doc_id", "start", "ids_crc32"], ["length"])
    counts = {r[0]: r[1] for r in ranked.groupBy("length").count().collect()}
    table = slots(plan(counts, window))

    def place(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 48 | table[:, 1]
        for b in it:
            length, rank = (b.column(k).to_numpy().astype(np.int64) for k in ("length", "q_pos"))
            row = table[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            at = rank - row[:, 1]
            sequence, offset = row[:, 2] + at // row[:, 3], row[:, 4] + at % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(length), b.column("ids_crc32"), b.column("doc_tokens"), pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "q_pos").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
