"""Cached use of the public tokenizers inside Python workers."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterable

#: Entries of each of a cache's two generations: some 200 bytes each.
CACHE_ENTRIES = 200_000
_STATE = "docquarry_worker_state"


def kept(name: str, make: Callable):
    """One object per Python worker and name, also across tasks."""
    state = sys.modules.setdefault(_STATE, type(sys)(_STATE)).__dict__
    if name not in state:
        state[name] = make()
    return state[name]


def kept_for(user: str, name: str, make: Callable):
    """As kept(), for caches: a worker that comes to another user's tasks drops those of the user before."""
    box = kept("caches", lambda: {"user": None})
    if box["user"] != user:
        box.clear()
        box["user"] = user
    if name not in box:
        box[name] = make()
    return box[name]


def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(f"tokenizer:{name}", lambda: Tokenizer.from_file(public_tokenizers.path(name)))


class Remembered(dict):
    """encode(key) for each key asked for, remembered; call rest() now and then to drop the older half of a full memory."""

    def __init__(self, encode: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.entries, self.old = encode, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.encode(key)
        self[key] = value
        return value

    def rest(self) -> None:
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it is printable Latin-1, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = str.maketrans({chr(b): c for b, c in byte_letters().items()})


def as_letters(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_LETTERS)


_BYTES = {c: b for b, c in byte_letters().items()}


def from_letters(piece: str) -> str:
    return bytes(map(_BYTES.__getitem__, piece)).decode()


def slices(lengths: Iterable[int], most: int) -> Iterable[tuple[int, int]]:
    """Runs [i, j) of rows with at most `most` in sum, or a single longer row."""
    start, total, j = 0, 0, -1
    for j, n in enumerate(lengths):
        if total and total + n > most:
            yield start, j
            start, total = j, 0
        total += n
    if j >= start:
        yield start, j + 1
