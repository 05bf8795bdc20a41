import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from docquarry.llm import jaccard_join, partenum
from docquarry.llm.bytewords import chunks
from docquarry.llm.components import components
from docquarry.runtime import shared_folder


def shingles(text, n):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def classes(rows, n, num, den):
    """By comparing all pairs that share a shingle."""
    sets = [(r.doc_id, shingles(r.text, n)) for r in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        (i, s), (j, t) = sets[a], sets[b]
        if i is not None and j is not None and den * len(s & t) >= num * len(s | t):
            x, y = sorted((top(i), top(j)))
            parent[y] = x
    return Counter((i, len(s), top(i) if i is not None else None) for i, s in sets)


def edited(rng, words, rate, pool):
    return [w if rng.random() > rate else rng.choice(pool) for w in words]


def test_brute_force(spark, small, odd, empty):
    for df in (small, odd):
        got = jaccard_join.link_classes(df)
        assert Counter(tuple(r) for r in got.collect()) == classes(df.collect(), 4, 85, 100)
    assert jaccard_join.link_classes(empty).count() == 0


def test_chains_and_groups(spark):
    """Groups around a base at, above and below the threshold; chains; very short texts; a passage that many share."""
    rng, rows = random.Random(5), []
    pool = [f"w{i}" for i in range(4000)]
    passage = rng.choices(pool, k=30)
    for g in range(30):
        base = rng.choices(pool, k=rng.choice([3, 5, 8, 12, 30, 80, 200, 700]))
        for _ in range(12):
            rows.append(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.03, 0.045, 0.06]), pool))
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, 0.02, pool)
            rows.append(chain)
        rows.append(rng.choices(pool, k=20) + passage + rng.choices(pool, k=rng.choice([5, 20])))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(6)
    for n, num, den in ((4, 85, 100), (5, 80, 100)):
        want = classes(df.collect(), n, num, den)
        assert Counter(tuple(r) for r in jaccard_join.link_classes(df, n, num, den).collect()) == want
    kept = {r.doc_id for r in jaccard_join.keep_first(df).collect()}
    assert kept == {i for (i, _, c) in want if i == c}


def test_signatures_never_miss():
    rng = np.random.default_rng(3)
    scheme = partenum.Scheme()
    for _ in range(2000):
        n = int(rng.choice([1, 2, 5, 6, 7, 13, 14, 20, 40, 100, 333, 2500]))
        both = rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)
        extra = int(rng.integers(0, n // 5 + 2))
        a = np.unique(np.concatenate([both, rng.integers(0, 1 << 64, int(rng.integers(0, extra + 1)), dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 1 << 64, int(rng.integers(0, extra + 1)), dtype=np.uint64)]))
        if partenum.linked(a, b, 85, 100):
            assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size
            x = partenum.folded([partenum.sketch(a, 20), partenum.sketch(b, 40)])
            assert int(np.bitwise_count(x[0] ^ x[1]).sum()) <= partenum.most_apart(len(a) + len(b), 85, 100)


def test_components(spark):
    path = [(i, i + 1) for i in range(10, 60)] + [(100, 7), (7, 7), (None, 3)]
    df = spark.createDataFrame(path, "u long, v long")
    got = {tuple(r) for r in components(df).collect()}
    assert got == {(i, 10) for i in range(10, 61)} | {(100, 7), (7, 7)}
    assert components(df.limit(0)).count() == 0


def test_signatures_are_packed_and_shared_ones_told():
    """Buckets hold each document's signatures in less than 12 bytes each; of signatures with the same documents one is told, with all of them."""
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(500)]
    texts = [" ".join(w) for _ in range(60) for base in [rng.choices(pool, k=rng.choice([2, 9, 60, 400]))] for w in (base, edited(rng, base, 0.01, pool), edited(rng, base, 0.02, pool))]
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["doc_id", "text"])
    scheme, holders, signed = partenum.Scheme(), {}, set()
    for lo, _, t in chunks(batch.column(1), lower=True):
        for i, s in enumerate(partenum.sets(t, 4)):
            for key in [] if s.tobytes() in signed else scheme.signatures(s).tolist():
                holders.setdefault(key >> 8, set()).add(ids[lo + i])
            signed.add(s.tobytes())  # a task's equal sets sign once
    packed = list(jaccard_join._signatures([batch], 4, scheme, 7))
    assert sum(b.nbytes for b in packed) < 17 * sum(map(len, holders.values()))
    assert len(pa.compress(b"".join(x.as_py() for b in packed for c in (1, 2) for x in b.column(c)), "lz4", asbytes=True)) < 12 * sum(map(len, holders.values()))
    told = []
    for k in range(7):
        of = [b.filter(pa.array([x == k for x in b.column(0).to_pylist()])) for b in packed]
        here = {}
        for b in jaccard_join._shared(of):
            for key, i, lead, places, e, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                here.setdefault((key, lead, places, e, f), []).append(i)
        for (key, lead, places, e, f), others in here.items():
            assert key % 7 == k and {lead, *others} == holders[key] and lead < min(others) and places == len(others) and (places > 1) == (e != 0 or f != 0)
        sets_here = [frozenset((lead, *others)) for (_, lead, *_), others in here.items()]
        assert len(sets_here) == len(set(sets_here))
        assert set(sets_here) == {frozenset(h) for key, h in holders.items() if len(h) > 1 and key % 7 == k}
        told += sets_here
    assert told


def test_large_groups_in_blocks_and_second_rounds(spark, monkeypatch):
    """Groups just below the threshold, with more likely pairs than rows, compared in blocks of few rows; few tables stay behind."""
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(6):
        base = rng.choices(pool, k=200)
        rows += [edited(rng, base, rng.choice([0.01, 0.017, 0.02, 0.023]), pool) for _ in range(40)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    want = classes(df.collect(), 4, 85, 100)
    jvm = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    tables = lambda: len(jvm.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm))
    for most in (4096, 7):
        monkeypatch.setattr(jaccard_join, "GROUP_ROWS", most)
        before = tables()
        assert Counter(tuple(r) for r in jaccard_join.link_classes(df).collect()) == want
        assert tables() - before <= 6
