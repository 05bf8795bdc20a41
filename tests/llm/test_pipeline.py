from collections import Counter

import corpus_pipeline
from docquarry.llm import mixture, packing, repetition, toxicity
from tests.llm.test_jaccard_join import classes
from tests.llm.test_repetition import base, inside
from tests.llm.test_tokens import pieces_of


def good(text):
    b = base(text)
    words = (text or "").split()
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        chars = sum(map(len, line.split()))
        lines += chars if chars and line in seen else 0
        seen.add(line)
    dup = [sum(len(w) for w, x in zip(words, inside(words, n), strict=True) if x) for n in repetition.LENGTHS]
    return b[0] >= 20 and 100 * b[4] <= 30 * b[0] and lines <= repetition.MOST_LINES * b[1] and all(d <= m * b[1] for d, m in zip(dup, repetition.MOST_NGRAM, strict=True))


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = [r for r in docs.collect() if good(r.text)]
    scorer = toxicity.fit(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r in rows if scorer.score(r.text) < 0.7]
    rows = [r for r in rows if (r.doc_id, r.doc_id) in {(i, c) for i, _, c in classes(rows, 5, 80, 100)}]
    copies = {r.doc_id: r.copies for r in mixture.mixed_sizes(spark.createDataFrame(rows, docs.schema)).collect()}
    want = Counter()
    for r in rows:
        for p in pieces_of(r.text):
            want[r.doc_id, *p] += copies[r.doc_id]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == +want
    assert max(Counter(r.sequence_id for r in got for _ in range(r.length)).values()) <= packing.WINDOW


def test_stage_columns(spark, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, "/root/testdata/sf0.001").columns == df.columns
            assert stage(spark, df, "/root/testdata/sf0.001").count() <= 3 * df.count()
