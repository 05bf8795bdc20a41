"""A small causal self-attention language model on subword ids, in numpy.

The next id's probability is P(class | context) * P(id | class, id before). Frequent ids are classes of their own; the others
share classes by how often they occur and by whether they end a word, and which id of a class follows the id before in its
word comes from counts over the whole corpus. One attention layer reads the context: with t the last input and j <= t the inputs of its window,

    weights = softmax_j(q[x_t] . k[x_j] + r[t - j]),  h = e[x_t] + sum_j weights_j v[x_j],  P(class) = softmax(h u + b)

Keys, queries and values are tables by input, as there is no layer below, so scoring takes no products before attention.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Inputs seen before the first scored place of a window, and places scored in it.
CONTEXT, SCORED = 8, 24
SPAN = CONTEXT + SCORED
#: Frequent inputs with an own row, classes, of which single ids, width of embeddings, of keys.
INPUTS, CLASSES, SINGLE, WIDTH, KEYS = 2048, 128, 96, 24, 8
#: Weight of P(id | class) among the counts of ids behind an id.
SMOOTH = 1.0
#: Windows scored at once.
BATCH = 256
_NEVER = np.float32(-1e4)


@dataclass
class Layout:
    """How ids become inputs and classes. The input after the last one is the text's beginning."""

    row: np.ndarray
    cls: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, final: np.ndarray, inputs: int = INPUTS, classes: int = CLASSES, single: int = SINGLE) -> Layout:
        order = np.argsort(-counts, kind="stable")
        c = np.zeros(len(counts), np.int32)
        c[order[:single]] = np.arange(single)
        rest, shared = order[single:], (classes - single) // 2
        for part, start in ((rest[final[rest]], single), (rest[~final[rest]], single + shared)):
            mass = np.cumsum(counts[part] + 1.0)
            c[part] = start + np.minimum(shared - 1, (mass - 0.5) / max(mass[-1] if len(mass) else 1, 1) * shared).astype(np.int32)
        row = inputs + c
        row[order[:inputs]] = np.arange(min(inputs, len(order)))
        return cls(row.astype(np.int32), c)

    @property
    def begin(self) -> int:
        return INPUTS + CLASSES


@dataclass
class Model:
    e: np.ndarray
    v: np.ndarray
    q: np.ndarray
    k: np.ndarray
    r: np.ndarray
    u: np.ndarray
    b: np.ndarray

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.e, self.v, self.q, self.k, self.r, self.u, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def like(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for p in self.parts:
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(*out)

    def bias(self) -> np.ndarray:
        """r by distance for each scored place and input of a window, with later inputs ruled out."""
        apart = (np.arange(CONTEXT, SPAN)[:, None] - np.arange(SPAN)[None, :]).astype(int)
        return np.where(apart >= 0, self.r[np.maximum(apart, 0)], _NEVER).astype(np.float32)


def begin(follows: np.ndarray, rng: np.random.Generator) -> Model:
    """A model without attention whose e and u are the leading factors of log P(class | input) over follows (inputs x classes)."""
    prior = (follows.sum(0) + 1) / (follows.sum() + follows.shape[1])
    weight = follows.sum(1) + 1.0
    table = np.log((follows + 4 * prior) / (follows.sum(1, keepdims=True) + 4)) - np.log(prior)
    left, size, right = np.linalg.svd(np.sqrt(weight)[:, None] * table, full_matrices=False)
    d = min(WIDTH, len(size))
    scale = np.sqrt(size[:d] / np.sqrt(weight.sum()))
    e, u = np.zeros((len(table), WIDTH)), np.zeros((WIDTH, follows.shape[1]))
    e[:, :d] = left[:, :d] * (size[:d] / np.maximum(scale, 1e-9)) / np.sqrt(weight)[:, None]
    u[:d] = right[:d] * scale[:, None]
    draw = lambda *shape: rng.normal(0, 0.05, shape)
    return Model(*(x.astype(np.float32) for x in (e, draw(len(table), WIDTH) * 0.2, draw(len(table), KEYS), draw(len(table), KEYS), -0.1 * np.arange(SPAN), u, np.log(prior))))


def forward(m: Model, bias: np.ndarray, x: np.ndarray, seen: np.ndarray) -> tuple:
    """x: inputs, windows x SPAN; seen: which of them exist. Logits for the SCORED last places, and what training needs."""
    keys, query, values = m.k[x], m.q[x[:, CONTEXT:]], m.v[x]
    score = np.matmul(query, keys.transpose(0, 2, 1))
    score += bias
    if not seen.all():
        score += np.where(seen, np.float32(0), _NEVER)[:, None, :]
    np.clip(score, _NEVER, 30, out=score)
    np.exp(score, out=score)
    score /= score.sum(2, keepdims=True) + np.float32(1e-30)
    h = np.matmul(score, values)
    h += m.e[x[:, CONTEXT:]]
    logits = h.reshape(-1, WIDTH) @ m.u
    logits += m.b
    np.clip(logits, -40, 40, out=logits)
    return logits, score, h, keys, query, values


def log_class(logits: np.ndarray, cls: np.ndarray) -> np.ndarray:
    own = logits[np.arange(len(cls)), cls].astype(np.float64)
    return own - np.log(np.exp(logits) @ np.ones(logits.shape[1], np.float32))


class Scorer:
    """forward() with fewer passes over memory: values carry a one that sums the weights, embeddings one that adds b."""

    def __init__(self, m: Model):
        ones, zeros = np.ones((len(m.e), 1), np.float32), np.zeros((len(m.e), 1), np.float32)
        self.m, self.bias = m, m.bias()
        self.e, self.v, self.u = np.hstack([m.e, ones]), np.hstack([m.v, ones]), np.vstack([m.u, m.b])

    def log_class(self, x: np.ndarray, seen: np.ndarray, cls: np.ndarray) -> np.ndarray:
        late = x[:, CONTEXT:]
        score = np.matmul(self.m.q[late], self.m.k[x].transpose(0, 2, 1))
        score += self.bias
        if not seen.all():
            score += np.where(seen, np.float32(0), _NEVER)[:, None, :]
        np.minimum(score, 30, out=score)
        np.exp(score, out=score)
        h = np.matmul(score, self.v[x])
        h /= h[:, :, WIDTH:] + np.float32(1e-30)
        h[:, :, WIDTH] = 0
        h += self.e[late]
        logits = h.reshape(-1, WIDTH + 1) @ self.u
        out = log_class(logits, cls)
        if not np.isfinite(out).all():  # the exponentials left their range
            out = log_class(np.clip(logits, -40, 40), cls)
        return out


_APART = np.arange(CONTEXT, SPAN)[:, None] - np.arange(SPAN)[None, :]
_CAUSAL = _APART >= 0


class Descent:
    """Adagrad from a model, batch by batch; a step changes only the rows of tables that its inputs name.

    Tables that are read at the same places lie side by side (e and q at scored places, v and k at all of a window's), and b is the last row of u.
    """

    def __init__(self, m: Model, rate: float = 0.05):
        self.rate = rate
        self.parts = [np.hstack([m.e, m.q]), np.hstack([m.v, m.k]), m.r.copy(), np.vstack([m.u, m.b])]
        self.total = [np.full(p.shape, 1e-2, np.float32) for p in self.parts]

    @property
    def m(self) -> Model:
        late, every, r, u = self.parts
        return Model(*(np.ascontiguousarray(x) for x in (late[:, :WIDTH], every[:, :WIDTH], late[:, WIDTH:], every[:, WIDTH:], r, u[:WIDTH], u[WIDTH])))

    def _dense(self, i: int, g: np.ndarray) -> None:
        t = self.total[i]
        t += g * g
        self.parts[i] -= self.rate * g / np.sqrt(t)

    def _rows(self, i: int, x: np.ndarray, g: np.ndarray) -> None:
        order, first, rows = grouped(x)
        g = np.add.reduceat(g.reshape(-1, g.shape[-1])[order], first, axis=0)
        t = self.total[i][rows] + g * g
        self.total[i][rows] = t
        g *= self.rate
        g /= np.sqrt(t, out=t)
        self.parts[i][rows] -= g

    def step(self, xs: np.ndarray, ss: np.ndarray, cls: np.ndarray, known: np.ndarray) -> None:
        late, ks = xs[:, CONTEXT:], known.reshape(-1)
        eq, vk = self.parts[0][late], self.parts[1][xs]
        q, v, k, u = eq[..., WIDTH:], vk[..., :WIDTH], vk[..., WIDTH:], self.parts[3]
        w = np.matmul(q, k.transpose(0, 2, 1))
        w += np.where(_CAUSAL, self.parts[2][np.maximum(_APART, 0)], _NEVER)
        if not ss.all():
            w += np.where(ss, np.float32(0), _NEVER)[:, None, :]
        np.exp(np.clip(w, _NEVER, 30, out=w), out=w)
        w /= w.sum(2, keepdims=True) + np.float32(1e-30)
        h = np.ones((*late.shape, WIDTH + 1), np.float32)
        np.add(np.matmul(w, v), eq[..., :WIDTH], out=h[..., :WIDTH])
        h = h.reshape(-1, WIDTH + 1)
        p = h @ u
        np.exp(np.clip(p, -40, 40, out=p), out=p)  # clipped, so no largest one needs to be taken off
        share = (ks / max(1, ks.sum())).astype(np.float32)
        p *= (share / (p @ np.ones(p.shape[1], np.float32)))[:, None]
        p[np.arange(len(p)), cls.reshape(-1)] -= share  # now the gradient by logits
        dh = (p @ u[:WIDTH].T).reshape(*late.shape, WIDTH)
        ds = np.matmul(dh, v.transpose(0, 2, 1))
        ds -= np.einsum("bij,bij->bi", w, ds)[..., None]
        ds *= w
        back = w.transpose(0, 2, 1), ds.transpose(0, 2, 1)
        self._rows(0, late, np.concatenate([dh, np.matmul(ds, k)], axis=2))
        self._rows(1, xs, np.concatenate([np.matmul(back[0], dh), np.matmul(back[1], q)], axis=2))
        self._dense(2, np.bincount(_APART[_CAUSAL], ds.sum(0)[_CAUSAL], SPAN).astype(np.float32))
        self._dense(3, h.T @ p)


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of x by value, where each value begins among them, and the values."""
    flat = x.reshape(-1)
    order = np.argsort(flat, kind="stable")
    by_value = flat[order]
    first = np.flatnonzero(np.concatenate([[True], by_value[1:] != by_value[:-1]]))
    return order, first, by_value[first]


def train(m: Model, x: np.ndarray, seen: np.ndarray, cls: np.ndarray, known: np.ndarray, rounds: int = 2, batch: int = 32, rate: float = 0.05) -> Model:
    """Adagrad on windows in their given order; cls, known: class of the id at each scored place, and whether there is one."""
    d = Descent(m, rate)
    for _ in range(rounds):
        for i in range(0, len(x), batch):
            d.step(x[i : i + batch], seen[i : i + batch], cls[i : i + batch], known[i : i + batch])
    return d.m


@dataclass
class Tiles:
    """Windows that score each place of some pieces of texts once: inputs and classes by place, and each window's first scored place and piece's bounds."""

    inputs: np.ndarray
    cls: np.ndarray
    start: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, pieces: list[tuple[bool, np.ndarray]], layout: Layout) -> Tiles:
        """pieces: whether a text begins with it, and its ids; others begin with CONTEXT + 1 ids that are not scored."""
        ids = np.concatenate([i for _, i in pieces]).astype(np.int64)
        opens = np.array([o for o, _ in pieces])
        lengths = np.array([len(i) for _, i in pieces], np.int64)
        before = np.cumsum(lengths) - lengths
        inputs = np.empty(len(ids), np.int16 if layout.begin < 1 << 15 else np.int32)
        inputs[1:] = layout.row[ids[:-1]]
        inputs[before[opens]] = layout.begin
        low, high = before + ~opens, before + lengths  # the first id of a piece inside a text is an input only
        scored = low + np.where(opens, 0, CONTEXT)
        n = -(-(high - scored) // SCORED)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return cls(inputs, layout.cls[ids].astype(np.int16), np.repeat(scored, n) + k * SCORED, np.repeat(low, n), np.repeat(high, n))

    def windows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """x, seen, cls and known of some windows, as train() takes them."""
        at = self.start[some][:, None] + np.arange(-CONTEXT, SCORED)[None, :]
        seen = (at >= self.low[some][:, None]) & (at < self.high[some][:, None])
        at = np.where(seen, at, 0)
        return np.where(seen, self.inputs[at], 0).astype(np.int32), seen, self.cls[at[:, CONTEXT:]].astype(np.int32), seen[:, CONTEXT:]


def train_tiles(m: Model, tiles: Tiles, rng: np.random.Generator, rounds: int = 2, batch: int = 32) -> Model:
    """train() on all windows in a drawn order, made as they are needed."""
    d, order = Descent(m), rng.permutation(len(tiles.start))
    for _ in range(rounds):
        for i in range(0, len(order), BATCH):
            block = tiles.windows(order[i : i + BATCH])
            for j in range(0, len(block[0]), batch):
                d.step(*(a[j : j + batch] for a in block))
    return d.m


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, seen) of windows over texts with these numbers of ids, laid end to end: each place is scored in one window."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    n = -(-lengths // SCORED)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    at = (starts[text] + k * SCORED)[:, None] + np.arange(-CONTEXT, SCORED)[None, :]
    seen = (at >= starts[text][:, None]) & (at < starts[text + 1][:, None])
    return np.where(seen, at, 0), seen


def log_probs(m: Model, layout: Layout, log_id: np.ndarray | Inside, texts: list[np.ndarray]) -> np.ndarray:
    """log10 P(text) for texts as ids (each with its end): every id scored once. log_id: log P(id | class) by id, or by id and the one before."""
    out = np.zeros(len(texts))
    lengths = np.array([len(t) for t in texts], np.int64)
    ids = np.concatenate(texts).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    inputs = np.empty(len(ids), np.int32)
    inputs[1:] = layout.row[ids[:-1]]
    inputs[(np.cumsum(lengths) - lengths)[lengths > 0]] = layout.begin
    at, seen = windows(lengths)
    owner = np.repeat(np.arange(len(texts)), lengths)
    cls, scorer = layout.cls[ids], Scorer(m)
    own = log_id.log(ids, inputs == layout.begin) if isinstance(log_id, Inside) else log_id[ids]
    for i in range(0, len(at), BATCH):
        a, s = at[i : i + BATCH], seen[i : i + BATCH]
        place, real = a[:, CONTEXT:].ravel(), s[:, CONTEXT:].ravel()
        lp = scorer.log_class(inputs[a], s, cls[place]) + own[place]
        lp[~real] = 0
        out += np.bincount(owner[place], lp, len(texts))
    return out / np.log(10)


def log_id_given_class(counts: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Natural log of P(id | class), with one added to every count."""
    c = counts.astype(np.float64) + 1
    return np.log(c / np.bincount(cls, c, CLASSES)[cls])


@dataclass
class Inside:
    """P(id | class, id before in its word), by counts of such pairs, smoothed by SMOOTH times P(id | class).

    keys: pairs (before * size + id), sorted, with their logs; places: (before * CLASSES + class), sorted, with the log of what the
    counted pairs leave to the others of the class. A word's first id has `size` before it.
    """

    keys: np.ndarray
    logs: np.ndarray
    places: np.ndarray
    left: np.ndarray
    log_id: np.ndarray
    cls: np.ndarray
    final: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, log_id: np.ndarray, classes: np.ndarray, final: np.ndarray) -> Inside:
        order = np.argsort(keys)
        keys, n, size = keys[order], n[order].astype(np.float64), len(classes)
        place = keys // size * CLASSES + classes[keys % size]
        places, at = np.unique(place, return_inverse=True)
        total = np.bincount(at, n, len(places)) + SMOOTH
        logs = np.log((n + SMOOTH * np.exp(log_id[keys % size])) / total[at]) if len(keys) else np.zeros(0)
        return cls(keys, logs.astype(np.float32), places, np.log(SMOOTH / total).astype(np.float32), log_id, classes, final)

    def log(self, ids: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """For ids in order; opens: which of them begin a text."""
        out = self.log_id[ids]
        some = np.flatnonzero(out < 0)  # an id alone in its class is certain
        before = np.where(opens[some] | self.final[ids[some - 1]], len(self.cls), ids[some - 1])
        key, place = before * len(self.cls) + ids[some], before * CLASSES + self.cls[ids[some]]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[some[hit]] = self.logs[at[hit]]
            some, place = some[~hit], place[~hit]
            at = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
            out[some] += np.where(self.places[at] == place, self.left[at], 0)
        return out


def word_pairs(words: list[np.ndarray], n: np.ndarray, layout: Layout, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of Inside and their counts in words as ids, n of each, for ids that share their class."""
    lengths = np.array([len(w) for w in words], np.int64)
    ids = np.concatenate([*words, np.zeros(0, np.uint32)]).astype(np.int64)
    before = np.empty(len(ids), np.int64)
    before[1:] = np.where(final[ids[:-1]], len(final), ids[:-1])
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = len(final)
    shared = np.bincount(layout.cls, minlength=CLASSES)[layout.cls[ids]] > 1
    keys, at = np.unique((before * len(final) + ids)[shared], return_inverse=True)
    return keys, np.bincount(at, np.repeat(np.asarray(n, np.float64), lengths)[shared], len(keys)).astype(np.int64)


def word_steps(words: list[np.ndarray], n: np.ndarray, layout: Layout) -> np.ndarray:
    """Of words as ids, n of each: how often each class follows each input inside them, opens one, and each input closes one; laid end to end."""
    n, has = np.asarray(n, np.float64), np.array([len(w) > 0 for w in words], bool)
    ids = np.concatenate([*words, np.zeros(0, np.uint32)]).astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    stops = np.cumsum(lengths)
    inner = np.ones(len(ids), bool)
    inner[stops[has] - 1] = False
    at = np.flatnonzero(inner)
    inside = np.bincount(layout.row[ids[at]].astype(np.int64) * CLASSES + layout.cls[ids[at + 1]], np.repeat(n, lengths)[at], (layout.begin + 1) * CLASSES)
    first = np.bincount(layout.cls[ids[(stops - lengths)[has]]], n[has], CLASSES)
    last = np.bincount(layout.row[ids[stops[has] - 1]], n[has], layout.begin + 1)
    return np.concatenate([inside, first, last]).astype(np.int64)


def follows(steps: np.ndarray, layout: Layout, end: int, n_texts: int) -> np.ndarray:
    """How often each class follows each input, inside words and, as if words were drawn one by one, across them; steps: the sum of word_steps()."""
    cells = (layout.begin + 1) * CLASSES
    out, first, last = steps[:cells].reshape(-1, CLASSES).astype(np.float64), steps[cells : cells + CLASSES].astype(np.float64), steps[cells + CLASSES :].astype(np.float64)
    first[layout.cls[end]] += n_texts
    last[layout.begin] += n_texts
    return out + last[:, None] * first[None, :] / max(first.sum(), 1)
