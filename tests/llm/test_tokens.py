import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from docquarry.llm import packing, tokencount, tokens
from docquarry.runtime import tidied


ODD_TEXTS = ["日本語のテキスト。 日本", "Привет  мир\n\n x", "a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>", "<|x|> <| it's", "e\u0301 ﬁ ½ ٣ 😀😀 \u200b\u00a0x", "\x1c\x85\u2028 z", "dog's DOG'S 'll 12345"]


def test_counts_equal_the_library(spark, small, odd, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = spark.createDataFrame([(i, x) for i, x in enumerate(ODD_TEXTS * 2)], "doc_id long, text string")
    for df in (small, odd, more):
        want = Counter((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in df.collect())
        for head in (tokencount.HEAD_PARTS, 3):
            assert Counter(tuple(r) for r in tokencount.token_counts(df, head_parts=head).collect()) == want
    assert tokencount.token_counts(empty).count() == 0


def test_each_pre_token_is_counted_once(small):
    """The table of distinct pre-tokens holds each once, with its frequency over all texts and the library's number of tokens."""
    split, t = tokencount.splitter(tokencount.TOKENIZER), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(p for r in small.collect() for p in split(r.text)[0])
    rows = tokencount.piece_counts(small).collect()
    assert len(rows) == len(want) and {r.part: r.n for r in rows} == want
    assert all(r.pieces == len(t.encode(r.part, add_special_tokens=False).ids) for r in rows[:500])
    plan = tokencount.token_counts(small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan


def pieces_of(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
    return [(s, len(p := ids[s : s + 2048]), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)]


def test_packing(small, odd, empty):
    for df in (small, odd):
        rows = packing.pack(df).collect()
        want = Counter()
        for r in df.collect():
            for p in pieces_of(r.text):
                want[r.doc_id, *p] += 1
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
        windows = defaultdict(list)
        for r in rows:
            windows[r.sequence_id].append((r.offset, r.length))
        fill = []
        for parts in windows.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
            fill.append(at)
        assert set(windows) == set(range(len(windows)))
        assert len(windows) <= -(-sum(fill) // 2048) + 1
    assert packing.pack(empty).count() == 0


def test_subset_sums():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 40, 6), rng.integers(1, 4, 6), strict=True)}
        room = int(rng.integers(1, 120))
        sums = {0}
        for k, n in counts.items():
            sums = {s + i * k for s in sums for i in range(n + 1) if s + i * k <= room}
        taken = packing.fullest(counts, room)
        assert sum(k * v for k, v in taken.items()) == max(sums) and all(v <= counts[k] for k, v in taken.items())


def test_a_packing_worker_remembers_few_words():
    """However many distinct words pass a worker, it holds at most two generations of words and of parts, and cuts alike."""
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(map(chr, w)) for w in rng.integers(97, 123, (500, 7))) for _ in range(900)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], ["doc_id", "text"]) for i, t in enumerate(texts)]
    got = [tuple(r.values()) for b in packing.cut(batches, packing.TOKENIZER, packing.WINDOW, packing.END_ID) for r in b.to_pylist()]
    assert [r[1:] for r in got if r[0] >= 898] == [p for t in texts[898:] for p in pieces_of(t)]
    held = {k: len(v) + len(v.old) for k, v in tokens.kept("caches", dict).items() if isinstance(v, tokens.Remembered)}
    assert len(held) == 2 and sum(held.values()) < 2 * (packing.WORDS_KEPT + packing.PARTS_KEPT) + 2000 <= 402_000


def test_freed_memory_leaves_the_worker():
    """What a task freed below a block that stays is no longer the worker's once the task is over."""
    anonymous = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10
    pins = []

    def task():
        blocks = [np.ones(100_000, np.uint8) for _ in range(1500)]
        pins.append(np.ones(100_000, np.uint8))
        yield len(blocks)

    def untidied():
        yield from task()

    assert list(untidied()) == [1500]
    before = anonymous()
    assert list(tidied(task())) == [1500]
    assert before - anonymous() > 70
