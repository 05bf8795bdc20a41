"""Searches that keep their best rows inside tasks: hybrid retrieval and nearest vectors."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from docquarry import catalog
from docquarry.operators import retrieval
from docquarry.operators.topk import NO_ID, TopK
from docquarry.operators.vectors import VectorIndex, recall

SF = "/root/testdata/sf0.01"


def names(text):
    words = {w for w in re.split("[ \t\n\x0b\f\r]+", (text or "").translate(retrieval._PARTED)) if w}
    return {w[i : i + n] for w in words for n in (2, 3, 4) for i in range(len(w) - n + 1)} | words


def ranked(queries, docs, k):
    """Hybrid ranks from the rules, pair by pair."""
    bags = [(i, names(t)) for i, t in docs]
    df = Counter(t for _, b in bags for t in b)
    mean = max(sum(len(b) for _, b in bags) / len(bags), 1.0)
    place = lambda b: np.bincount([retrieval.Names()[t] % 128 for t in b], minlength=128)
    vectors = [place(b) for _, b in bags]
    out = []
    for q, text in queries:
        asked = names(text)
        v = place(asked)
        rows = []
        for (i, b), w in zip(bags, vectors, strict=True):
            bm25 = sum(math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) for t in asked & b) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(b) / mean))
            cosine = v @ w / math.sqrt((v @ v) * (w @ w)) if b and asked else 0.0
            rows.append((i, bm25, len(asked & b) / max(len(asked | b), 1), cosine))
        top = max((r[1] for r in rows), default=0) or 1.0
        scored = [(round(0.7 * r[1] / top + 0.2 * r[2] + 0.1 * r[3], 4), r[0]) for r in rows if r[1] > 0 or r[2] > 0 or r[3] >= 0.18]
        best = sorted((-s, i is None, i or 0) for s, i in scored if s > 0)[:k]
        out += [(q, None if none else i, n, -s) for n, (s, none, i) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 90")
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "é 日本語 x"), (None, "the null id"), (903, "a-b_c/d"), (902, "é 日本語 x")], "doc_id long, text string")
    return docs.union(odd).union(docs.where("doc_id % 9 = 0").selectExpr("doc_id + 1000", "text"))


def test_retrieval_against_rules(spark, texts):
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("item_id < 12").selectExpr("item_id AS query_id", "text AS query_text")
    asked = asked.union(spark.createDataFrame([(80, None), (81, ""), (82, "日本"), (83, "the the of"), (83, "the the of")], asked.schema))
    pairs = [tuple(r) for r in texts.collect()], [tuple(r) for r in asked.collect()]
    want = ranked(pairs[1], pairs[0], 5)
    for block in (1000, 4):
        got = retrieval.hybrid_rank(asked, texts, k=5, block=block)
        assert sorted(((r.query_id, r.doc_id, r["rank"], r.hybrid) for r in got.collect()), key=str) == want
    assert retrieval.hybrid_rank(asked, texts.limit(0)).count() == 0 == retrieval.hybrid_rank(asked.limit(0), texts).count()


def test_retrieval_shuffles_no_pairs(spark, texts):
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id AS query_id", "text AS query_text")
    got = retrieval.hybrid_rank(asked, texts, k=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan
    assert got.groupBy("query_id").count().where("count > 3").count() == 0


def test_topk_over_batches():
    rng = np.random.default_rng(1)
    for k in (1, 3, 50):
        kept = TopK(7, k)
        ids, query, score = rng.integers(0, 200, 4000), rng.integers(0, 6, 4000), rng.integers(0, 40, 4000) / 4
        ids[:20] = NO_ID
        for part in np.array_split(np.arange(4000), 30):
            kept.see(ids[part], query[part], score[part], score[part, None] * 2)
        q, i, s, extra = kept.rest()
        want = [x for j in range(7) for x in sorted(zip(-score[query == j], ids[query == j], strict=True))[:k]]
        assert [(-b, a) for a, b in zip(i.tolist(), s.tolist(), strict=True)] == want and (extra[:, 0] == 2 * s).all()
        assert (np.diff(q) >= 0).all()


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS id", "embedding")


def test_probed_recall(spark, vectors):
    exact = catalog.QUERIES["j2_dense_cosine"](spark, "/root/testdata/sf0.1").withColumnRenamed("vec_id", "id")
    probed = catalog.QUERIES["j2_probed_topk"](spark, "/root/testdata/sf0.1").withColumnRenamed("vec_id", "id")
    assert recall(probed, exact) >= 0.9
    assert recall(exact, exact) == 1.0


def test_probes_pay_where_vectors_cluster(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.15
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>")
    index = VectorIndex.build(df, cells=40)
    probes = index.probes_for(8)
    assert probes <= 6
    asked = df.where("id % 100 = 0")
    assert recall(index.nearest(asked, 8, probes=probes), index.nearest(asked, 8)) >= 0.9


def test_index_holds_every_row(vectors):
    index = VectorIndex.build(vectors, cells=16)
    assert index.cells.count() == vectors.count() == index.rows and len(index.centres) == 16
    v = np.array([r.v for r in index.cells.collect()])
    cell = np.array([r.cell for r in index.cells.collect()])
    angle = np.arccos(np.clip((v * index.centres[cell]).sum(axis=1), -1, 1))
    assert ((v @ index.centres.T).argmax(axis=1) == cell).all() and (angle <= index.widest[cell] + 1e-9).all()


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6, 8))[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.2
    v[7] = 0
    v[20:60] = v[20]  # forty equal vectors
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [None] * 8), (None, [1.0] * 8), (5, [float(x) for x in v[5]])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = VectorIndex.build(df, cells=9)
    real = [(i, np.array(x)) for i, x in rows if x and None not in x and any(x)]
    want = []
    for i, x in real:
        if i is None or i % 5:
            continue
        scores = sorted((-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 5), j is None, j or 0) for j, y in real if j != i)
        want += [(i, None if none else j, n, -s) for n, (s, none, j) in enumerate(scores[:4], 1)]
    assert [i for i, _ in real].count(5) == 2
    got = index.nearest(df.where("id % 5 = 0").dropDuplicates(["id"]), 4)
    want = sorted(set(want), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert VectorIndex.build(df.limit(0)).nearest(df, 4).count() == 0
