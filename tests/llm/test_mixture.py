import re
from collections import Counter, defaultdict


from docquarry.llm import mixture


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if t[s] > most * sizes[s] + 1e-9}
        if not over:
            return {**{s: most * sizes[s] for s in capped}, **t}
        capped |= over


def test_against_brute_force(small, odd):
    for df in (small, odd):
        rows, docs = mixture.mixed_sizes(df).collect(), df.collect()
        n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes = defaultdict(int)
        for d in docs:
            sizes[d.source] += n(d.text)
        want = fill(sizes)
        assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 4)) for r in rows) == Counter((d.doc_id, n(d.text), sizes[d.source], round(want[d.source], 4)) for d in docs)
        assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in rows)
        most, taken = defaultdict(int), defaultdict(int)
        for r in rows:
            taken[r.source_size, r.target] += r.taken
            most[r.source_size, r.target] = max(most[r.source_size, r.target], r["size"])
        assert all(abs(taken[t] - t[1]) <= most[t] for t in taken)


def test_reruns_and_mix(small, odd, empty):
    a, b = (sorted(mixture.mixed_sizes(small.repartition(k)).collect(), key=str) for k in (2, 7))
    assert a == b
    for df in (small, odd):
        got = Counter((r.doc_id, r.text) for r in mixture.mix(df).collect())
        want = Counter()
        drawn = defaultdict(int)
        for r in mixture.mixed_sizes(df).collect():
            drawn[r.doc_id] += r.copies
        for (i, _), c in got.items():
            want[i] += c
        assert {k: v for k, v in drawn.items() if v} == dict(want)
        assert mixture.mix(df).columns == df.columns
    assert mixture.mix(empty).count() == 0 == mixture.mixed_sizes(empty).count()




def test_mix_with_clashing_names(small):
    """Columns that are named like the operator's own come out as they went in, and change no draw."""
    names = ["q_hash", "q_copies", "q_copy", "q_doc", "q_same", "q_row", "q_pos", "q_src", "size", "copies", "target", "source_size"]
    df = small.selectExpr("*", *(f"concat('{n}', doc_id) AS {n}" for n in names))
    got = mixture.mix(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    want = Counter({r.doc_id: r.copies for r in mixture.mixed_sizes(small).collect() if r.copies})
    assert Counter(r.doc_id for r in rows) == want
