import math
import re
import zlib
from collections import Counter

import numpy as np

from docquarry.llm import attention as at
from docquarry.llm import lm_scores


def tokens(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), None]


def test_base_against_brute_force(small, odd, empty):
    for df, head in ((small, 200_000), (small, 300), (odd, 2)):
        rows = df.collect()
        out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = Counter(w for r in rows if not out(r.doc_id) for w in tokens(r.text))
        n, v = sum(c.values()), len(c)
        want = sorted(((r.doc_id or -1, out(r.doc_id), len(w := tokens(r.text)), sum(c[x] > 0 for x in w), n), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for r in rows)
        got = lm_scores.lm_scores(df, head_words=head).collect()
        assert sorted(((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens), round(r.base_score, 4)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scores.lm_scores(empty).count() == 0


def tiny():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 5000)
    layout = at.Layout.of(counts, rng.random(5000) < 0.5)
    model = at.begin(rng.random((layout.begin + 1, at.CLASSES)), rng)
    model.v[:] = rng.normal(0, 0.5, model.v.shape)
    return rng, counts, layout, model


def test_scores_are_probabilities():
    rng, counts, layout, model = tiny()
    log_id = at.log_id_given_class(counts, layout.cls)
    head = rng.integers(0, 5000, 11)
    total = at.log_probs(model, layout, log_id, [head])[0]
    each = at.log_probs(model, layout, log_id, [np.append(head, i) for i in range(5000)]) - total
    assert abs((10**each).sum() - 1) < 1e-3


def test_scorer_equals_forward():
    rng, _, layout, model = tiny()
    x = rng.integers(0, layout.begin + 1, (9, at.SPAN)).astype(np.int32)
    seen = rng.random(x.shape) < 0.8
    seen[:, at.CONTEXT :] = True
    cls = rng.integers(0, at.CLASSES, 9 * at.SCORED)
    assert np.allclose(at.log_class(at.forward(model, model.bias(), x, seen)[0], cls), at.Scorer(model).log_class(x, seen, cls), atol=1e-3)


def test_windows_score_each_place_once_and_causally():
    rng, counts, layout, model = tiny()
    log_id = at.log_id_given_class(counts, layout.cls)
    lengths = np.array([1, 23, 24, 25, 100, 0, 7])
    place, seen = at.windows(lengths)
    assert Counter(place[:, at.CONTEXT :][seen[:, at.CONTEXT :]].tolist()) == Counter(range(lengths.sum()))
    texts = [rng.integers(0, 5000, n) for n in lengths]
    together = at.log_probs(model, layout, log_id, texts)
    assert np.allclose(together, [at.log_probs(model, layout, log_id, [t])[0] for t in texts], atol=1e-3)
    a = rng.integers(0, 5000, 200)
    b = a.copy()
    b[150:] = rng.integers(0, 5000, 50)
    assert abs(at.log_probs(model, layout, log_id, [a[:150]])[0] - at.log_probs(model, layout, log_id, [b[:150]])[0]) < 1e-6


def test_gradients():
    rng, _, layout, model = tiny()
    x = rng.integers(0, layout.begin, (4, at.SPAN)).astype(np.int32)
    seen = np.ones(x.shape, bool)
    seen[0, :5] = False
    cls, known = rng.integers(0, at.CLASSES, (4, at.SCORED)), np.ones((4, at.SCORED), bool)
    loss = lambda m: -np.mean(at.log_class(at.forward(m, m.bias(), x, seen)[0], cls.ravel()))
    before = loss(model)
    after = loss(at.train(model, x, seen, cls, known, rounds=15))
    assert after < before - 0.3
    only = at.train(model, x, seen, cls, known, rounds=1, rate=1e-3)
    for k, name in enumerate(("e", "v", "q", "k", "r", "u", "b")):
        part = model.like(model.flat().copy())
        part.parts[k][...] = only.parts[k]
        assert loss(part) <= before + 1e-5, name


def test_training_helps(spark):
    """Held-out texts get more than from the training counts of their subword ids, by a factor of ten a word; the uniform bound holds with it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in lm_scores.lm_scores(docs).collect()}
    ids_of, counts, held = lm_scores._bytes_ids(lm_scores.TOKENIZER), Counter(), []
    for r in docs.collect():
        ids = [*np.frombuffer(b"".join(ids_of[w] for w in lm_scores.split(r.text)), np.uint32).tolist(), 49407]
        if got[r.doc_id].held_out:
            held.append((r.doc_id, ids))
        else:
            counts.update(ids)
    total = sum(counts.values())
    unigram = sum(math.log10((counts[i] + 1) / (total + 49408)) for _, ids in held for i in ids)
    score, words = sum(got[k].score for k, _ in held), sum(got[k].n_tokens for k, _ in held)
    assert score > 1.2 * words * -math.log10(49408) and score > unigram + words
    print(score / words, unigram / words, sum(got[k].base_score for k, _ in held) / words)


def slow_log10(model, layout, within, ids):
    """log10 P of a text, one id at a time by loops over its window."""
    total, rows = 0.0, [layout.begin, *layout.row[ids[:-1]]]
    for t, i in enumerate(ids):
        lo = max(0, t - t % at.SCORED - at.CONTEXT)
        w = [math.exp(min(30.0, float(model.q[rows[t]] @ model.k[rows[j]] + model.r[t - j]))) for j in range(lo, t + 1)]
        h = model.e[rows[t]] + sum(x * model.v[rows[j]] for x, j in zip(w, range(lo, t + 1), strict=True)) / sum(w)
        z = np.exp((h @ model.u + model.b).astype(np.float64))
        same = np.flatnonzero(layout.cls == layout.cls[i])
        before = len(layout.cls) if t == 0 or within.final[ids[t - 1]] else ids[t - 1]
        seen = {int(k) % len(layout.cls): n for k, n in within.counts.items() if k // len(layout.cls) == before and layout.cls[k % len(layout.cls)] == layout.cls[i]}
        one = math.exp(within.log_id[i])
        assert abs(np.exp(within.log_id[same]).sum() - 1) < 1e-6
        total += math.log(z[layout.cls[i]] / z.sum()) + (0 if len(same) == 1 else math.log((seen.get(int(i), 0) + at.SMOOTH * one) / (sum(seen.values()) + at.SMOOTH)))
    return total / math.log(10)


def test_scores_against_loops():
    """Batched masked attention over windows, classes and ids behind ids give what loops give, id by id."""
    rng, counts, layout, model = tiny()
    final = rng.random(5000) < 0.4
    texts = [rng.integers(0, 5000, n) for n in (1, 5, 24, 25, 60)]
    found = Counter()
    for t in texts[:3]:
        for a, b in zip([None, *t[:-1]], t, strict=True):
            found[int((5000 if a is None or final[a] else a) * 5000 + b)] += 3
    within = at.Inside.of(np.array(list(found)), np.array(list(found.values())), at.log_id_given_class(counts, layout.cls), layout.cls, final)
    within.counts = found
    assert np.allclose(at.log_probs(model, layout, within, texts), [slow_log10(model, layout, within, t) for t in texts], rtol=1e-4)
    for before in (5000, *texts[1][:3]):  # whatever stands before, a class's ids share a probability of one
        opens, ids = np.zeros(10000, bool), np.empty(10000, np.int64)
        ids[0::2], ids[1::2] = (0 if before == 5000 else before), np.arange(5000)
        opens[1::2] = before == 5000
        assert np.allclose(np.bincount(layout.cls, np.exp(within.log(ids, opens)[1::2]), at.CLASSES)[np.unique(layout.cls)], 1, atol=1e-4)


def test_training_takes_every_id(spark):
    """Pieces and their windows give each id of a training document once as a target, behind the ids before it."""
    rng = np.random.default_rng(1)
    texts = [None, "", "one", " ".join(rng.choice(["ab", "cde", "water", "stone", "light"], 20_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids_of, end, size = lm_scores._bytes_ids(lm_scores.TOKENIZER), 1, 49408
    layout = at.Layout(np.arange(size).astype(np.int32) % at.INPUTS, np.arange(size).astype(np.int32) % at.CLASSES)
    rows = sorted(lm_scores.train_pieces(docs, lm_scores.TOKENIZER, end, size, 5).collect(), key=lambda r: (r.id, r.place))
    assert len({r.shard for r in rows if r.id == 3}) > 1
    for k, text in enumerate(texts):
        ids = [*np.frombuffer(b"".join(ids_of[w] for w in lm_scores.split(text)), np.uint32).tolist(), end]
        tiles = at.Tiles.of([(r.opens, np.frombuffer(r.ids, "<u2")) for r in rows if r.id == k], layout)
        x, seen, cls, known = tiles.windows(np.arange(len(tiles.start)))
        assert cls[known].tolist() == layout.cls[ids].tolist()
        inputs = np.array([layout.begin, *layout.row[ids[:-1]]])
        place, have = at.windows(np.array([len(ids)]))
        assert (seen == have).all() and (x == np.where(have, inputs[place], 0)).all()


def test_training_sees_between_the_old_draws(spark):
    """Two corpora with the same counts, told apart only by the order of words in a stretch of one long document."""
    words = np.random.default_rng(2).choice(["ab", "cde", "water", "stone", "light", "running"], 12_000).tolist()
    other = words[:5000] + sorted(words[5000:5060]) + words[5060:]
    scores = []
    for w in (words, other):
        docs = spark.createDataFrame([(0, " ".join(w)), (1, "water running stone light ab cde")], "doc_id long, text string")
        scores.append([r.score for r in lm_scores.lm_scores(docs).orderBy("doc_id").collect()][1])
    assert scores[0] != scores[1]


def test_starting_tables_count_every_word(spark, small):
    """Steps inside words are those of all training words, whatever the number of words that tasks hold."""
    rng, _, layout, _ = tiny()
    words = [rng.integers(0, 5000, n) for n in (0, 1, 5, 2)]
    got = at.follows(at.word_steps(words, np.array([9, 3, 2, 1]), layout), layout, 7, 0)
    want, first, last = np.zeros_like(got), np.zeros(at.CLASSES), np.zeros(layout.begin + 1)
    for w, n in zip(words, (9, 3, 2, 1), strict=True):
        for a, b in zip(w[:-1], w[1:], strict=True):
            want[layout.row[a], layout.cls[b]] += n
        if len(w):
            first[layout.cls[w[0]]] += n
            last[layout.row[w[-1]]] += n
    assert np.allclose(got, want + last[:, None] * first[None, :] / first.sum())
    few, all_ = ({r.doc_id: r.score for r in lm_scores.lm_scores(small, head_words=h).collect()} for h in (3, 200_000))
    assert few.keys() == all_.keys() and all(math.isclose(few[k], all_[k], rel_tol=1e-4) for k in few)
