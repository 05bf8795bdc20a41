import re
from collections import Counter

import numpy as np

from docquarry.llm import repetition

LONG = "word%d and then some other thing goes here quite plainly now"


def base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, lines = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), lines, sum(inside(words, 8))


def inside(words, n):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    counts, hit = Counter(grams), [False] * len(words)
    for i, g in enumerate(grams):
        if counts[g] > 1:
            hit[i : i + n] = [True] * n
    return hit


def test_against_brute_force(small, odd, empty):
    for df in (small, odd):
        want = Counter()
        for r in df.collect():
            b = base(r.text)
            failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
            words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
            dup = [sum(len(w) for w, x in zip(words, inside(words, n), strict=True) if x) for n in repetition.LENGTHS]
            seen, lines = set(), 0
            for line in (r.text or "").split("\n"):
                chars = sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line)))
                lines += chars if chars and line in seen else 0
                seen.add(line)
            kept = not failed and lines <= repetition.MOST_LINES * b[1] and all(d <= m * b[1] for d, m in zip(dup, repetition.MOST_NGRAM, strict=True))
            want[(r.doc_id, *b, failed, kept, lines, *dup)] += 1
        got = repetition.coverage(df)
        assert Counter(tuple(r) for r in got.collect()) == want
        assert sorted((r.doc_id or -1, r.text or "") for r in repetition.keep_good(df).collect()) == sorted((r.doc_id or -1, r.text or "") for r in df.join(got.where("kept").select("doc_id").distinct(), "doc_id").collect())
    assert repetition.coverage(empty).count() == 0 == repetition.keep_good(empty).count()


def test_verdicts(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    texts = [clean, clean + " " + clean, "\n".join(["the same line again and again"] * 40), " ".join(f"x{i // 6}" for i in range(120)), clean + "\n" + "\n".join(["quoted once more today"] * 2)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.kept for r in sorted(repetition.coverage(df).collect())] == [True, False, False, False, True]


def test_hashes_tell_words_apart():
    from docquarry.llm.bytewords import read

    words = [f"{a}{b}" for a in "abcdefghij" for b in range(3000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    t = read(data, np.array([0, len(data)]), lower=False)
    assert len(np.unique(t.hashes)) == len(words)
