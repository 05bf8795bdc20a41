import zlib

import numpy as np

from docquarry.llm import toxicity


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / max(1, len(pos) * len(neg))


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert auc(held) > 0.75
    assert sum(s >= 0.7 for s, y in held if not y) <= 0.02 * len(held)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(toxicity.scores(docs, labels).collect()) == sorted(toxicity.scores(docs.repartition(5), turned).collect())


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 0, 1), (3, 0, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for df in (odd, empty):
        assert toxicity.scores(df, labels).count() == df.count() == toxicity.scores(df, labels.limit(0)).count()
    bad = spark.createDataFrame([(1, "you idiot"), (2, "all fine"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in toxicity.keep_civil(bad, labels.limit(0)).orderBy("doc_id").collect()] == [2, 3]


def test_label_model_discounts_copies():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.3).astype(float)
    fire = lambda hit, miss: (rng.random(len(y)) < np.where(y > 0, hit, miss)).astype(float)
    a, b, c = fire(0.7, 0.05), fire(0.6, 0.1), fire(0.5, 0.02)
    given = np.where(rng.random(len(y)) < 0.9, y, 1 - y)
    model = toxicity.fit_label_model(np.stack([a, a, a, b, c, given], 1), given)
    assert model.shared[0] > 2 > model.shared[3]
    assert abs(model.rates[1][0] - 0.7) < 0.05 and abs(model.rates[0][3] - 0.1) < 0.05
    assert np.mean((model.posterior(np.stack([a, a, a, b, c, given], 1)) > 0.5) == (y > 0)) > 0.93


def test_voters_against_brute_force(spark):
    """Each voter fires where its word, beginning or pattern stands, found by going through the text for every voter."""
    import re

    names = ["=idiot", "-=kind", "stup*", "-than*", "worthl*", *(f"#{k}" for k in toxicity.PATTERNS)]
    voters = toxicity.Voters(names)
    texts = [None, "", "You are such an IDIOT, idiot!!!", "thanks, kind soul", "STUPID AND UGLY", "what the f**k", "stupid worthless loser and again loser", "kindness"]

    def fires(name, text):
        bare, words = name.removeprefix("-"), re.findall(r"\w+", (text or "").lower())
        if bare[0] == "#":
            return re.search(toxicity.PATTERNS[bare[1:]], text or "", re.S) is not None
        return bare[1:] in words if bare[0] == "=" else any(w.startswith(bare[:-1]) for w in words)

    for t in texts:
        assert voters.fired(t) == {i for i, n in enumerate(names) if fires(n, t)}, t
    assert voters.toxic.tolist() == [n[0] != "-" for n in names]


def test_a_clean_voter_lowers_the_posterior():
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.3).astype(float)
    bad, good = (rng.random(len(y)) < np.where(y > 0, *p) for p in ((0.6, 0.05), (0.02, 0.4)))
    given = np.where(rng.random(len(y)) < 0.85, y, 1 - y)
    votes = np.stack([bad, good, given], 1).astype(float)
    model = toxicity.fit_label_model(votes, given, toxic=np.array([True, False]))
    a, b = model.posterior(np.array([[0, 0, 0], [0, 1, 0]], float))
    assert b < a and model.rates[1][1] <= model.rates[0][1] and model.rates[1][0] >= model.rates[0][0]
