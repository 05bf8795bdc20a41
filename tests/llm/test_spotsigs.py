import hashlib
import itertools

import numpy as np

from docquarry.llm import spotsigs


def test_against_brute_force(small, odd, empty, spark):
    for df in (small, odd, small.limit(1)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = []
        for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
            e = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
            s, es, ns = ({int(x) for x in spotsigs.signatures(z)} for z in (t, e, after))
            j = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), spotsigs.encode(spotsigs.signatures(t)), spotsigs.encode(spotsigs.signatures(e)), round(j(s, es), 9), round(j(s, ns), 9)))
        got = [(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in spotsigs.fingerprints(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        sets = {(r.doc_id, r.n_chars, r.edited_sha256): (spotsigs.decode(r.fingerprint), spotsigs.decode(r.edited_fingerprint), r.length_partition, r.edited_links) for r in spotsigs.fingerprints(df).collect()}
        for a, b, place, linked in sets.values():
            starts = spotsigs.partition_starts()
            assert place == sum(x <= len(a) for x in starts) - 1
            assert linked == (len(a) > 0 and len(b) > 0 and 100 * len(set(a.tolist()) & set(b.tolist())) >= 80 * len(set(a.tolist()) | set(b.tolist())))
        assert len(want) == 1 or sum(x[5] for x in want) > sum(x[6] for x in want)
    assert spotsigs.fingerprints(empty).count() == 0


def test_near_duplicates(small, odd, empty):
    for df in (small, odd):
        rows = [(r.doc_id, {int(x) for x in spotsigs.signatures(r.text or "")}) for r in df.collect() if r.doc_id is not None]
        parent = {i: i for i, _ in rows}

        def top(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for (i, s), (j, t) in itertools.combinations(rows, 2):
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        got = {(r.doc_id, r.component_id) for r in spotsigs.near_duplicates(df).collect() if r.doc_id is not None}
        assert got == {(i, top(i)) for i, _ in rows}
    assert spotsigs.near_duplicates(empty).count() == 0


def test_likeness_does_not_jump_with_the_number_of_spots():
    """A text of 7 spots and its copy with more are as alike as their words are."""
    body = [f"the left{k} right{k}" for k in range(7)]
    short = " ".join(body)
    for more in (1, 2, 3):
        longer = f"{short} {' '.join(f'the up{k} down{k}' for k in range(more))}"
        assert spotsigs.likeness(spotsigs.signatures(short), spotsigs.signatures(longer)) > 0.75 * 7 / (7 + more)


def test_pruned_jaccard_loses_nothing():
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n = int(rng.choice([1, 2, 4, 5, 9, 10, 40, 300]))
        base = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        a, b = (np.unique(np.concatenate([base[rng.random(n) > 0.1], rng.integers(0, 1 << 32, int(rng.integers(0, n // 8 + 2)), dtype=np.uint32)])) for _ in range(2))
        want = len(a) > 0 and len(b) > 0 and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert spotsigs.links(a, b) == want
