import hashlib
import random
import zlib

import numpy as np
import pytest

from docquarry.llm import registry, runs


def brute(words):
    """Every run by trying each period over the whole text."""
    ids = np.unique(np.array(words), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    best = {}
    for q in range(1, len(ids) // 4 + 1):
        edges = np.diff(np.concatenate([[0], (ids[q:] == ids[:-q]).astype(int), [0]]))
        for i, j in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
    return sorted((i, n, q) for (i, n), q in best.items())


def edited(doc_id, words):
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = edited(doc_id, (text or "").encode().split())
    found = brute(words)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    s, n, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), s, n, q, 1000 * n // q if found else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def found_in(*texts):
    first = np.cumsum([0, *map(len, texts)])
    return runs.runs_of(np.array([x for t in texts for x in t], np.int32), first)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_drawn_words(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(300):
        t = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(len(t) + 1)
            t[a:a] = t[a : a + rng.randrange(1, 6)] * rng.randrange(2, 7)
        texts.append(t)
    for t, got in zip(texts, found_in(*texts), strict=True):
        assert got == brute(t), t


def test_special_words():
    morse = [bin(i).count("1") % 2 for i in range(4096)]  # without any cube
    fibonacci = [0]
    other = [0, 1]
    for _ in range(14):
        fibonacci, other = other, other + fibonacci
    same, blocks = [7] * 5000, ([1] * 40 + [2]) * 50 + ([1] * 40 + [3]) * 50
    texts = [morse, fibonacci, same, blocks, [], [1] * 5, [1] * 6, [1, 2] * 3, [1, 2] * 4, morse + [0, 1, 1] * 700 + morse]
    assert found_in(*texts) == [brute(t) for t in texts]


def test_z_function():
    assert runs.z_function(list("aabaab")) == [6, 1, 0, 3, 1, 0]
    assert runs.z_function([]) == [] and runs.z_function([1]) == [1]


def test_query_against_brute_force(spark, small, odd, empty):
    got = registry.QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(digest(r.doc_id, r.text) for r in small.collect())
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(runs.run_digests(odd).collect()) == order(digest(r.doc_id, r.text) for r in odd.collect())
    assert runs.run_digests(empty).count() == 0


def test_output_reads_back(spark):
    df = spark.createDataFrame([(1, "so  the cat sat the cat sat\nthe cat sat the cat sat end"), (2, None)], "doc_id long, text string")
    one, two = sorted(runs.find_runs(df).collect())
    assert [tuple(r) for r in one.runs] == [(1, 12, 3)] and one.collapsed == "so the cat sat end" and one.n_words == 14
    assert two.runs == [] and two.collapsed == "" and two.n_words == 0
