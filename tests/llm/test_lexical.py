import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from docquarry.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n) // length if length else 0
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in Counter(terms(text)).items() if t in b)
            scores += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_terms():
    text = "Élan ÉLAN x_Y-z9 日本 a\x00b😀c \x80"
    (_, hi, t), = lexical.terms_of(pa.array([None, text, ""]))
    assert hi == 3 and t.n_words.tolist() == [0, len(terms(text)), 0]
    assert [t.data[a:b].tobytes().decode() for a, b in zip(t.starts, t.ends, strict=True)] == terms(text)


def test_against_brute_force(spark, small, odd, empty):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(900, None), (901, ""), (902, "the the THE of"), (902, "one x"), (None, "null id"), (903, "nowheretobefound")], "item_id long, text string")
    docs = small.select("doc_id", "text").union(odd.select("doc_id", "text")).union(small.where("doc_id < 30").select(small.doc_id + 1000, "text"))
    asked = items.union(more)
    assert rows(lexical.search(docs, asked)) == brute(pairs(docs), pairs(asked))
    assert rows(lexical.search(docs, more, k=3, block=2)) == brute(pairs(docs), pairs(more), 3)
    assert lexical.search(empty, asked).count() == 0 == lexical.search(docs, asked.limit(0)).count()


def test_bounds_hold_and_leave_little(spark, small):
    """Every exact score lies between its bounds; few pairs are scored exactly."""
    docs = small.select("doc_id", "text").repartition(3)
    items = lexical.Items.of([(i, r.item_id, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect())])
    index = lexical.build(docs, items.terms)
    every = lexical.bounds(index, items, 10_000).collect()
    exact = {(r.item_id, r.doc_id): r.score for r in lexical.top_documents(index, items, 10_000).collect()}
    ids = {r.row: r.doc_id for r in index.levels.collect()}
    assert len(every) >= len(exact) > 1000
    for r in every:
        assert r.low <= exact.get((items.ids[r.item], ids[r.row]), 0) <= r.high
    assert lexical.bounds(index, items, 10).count() < len(every) / 3


def test_impacts_are_rounded_up():
    tf, n = np.array([1, 1, 7, 1000]), np.array([1, 10**7, 50, 1000])
    s = lexical.saturation(tf, n, 1000, 10**5)
    units = -(-s // lexical.UNIT)
    assert (units * lexical.UNIT >= s).all() and ((units - 1) * lexical.UNIT < s).all() and units.max() <= 255
