"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.runtime import checkpointed, ship, tidied

#: Labelled rows to learn from: those with the smallest hashes of doc_id.
LABELLED_ROWS = 10_000
#: Voters mined from them at most, beside the fixed ones.
MINED, MINED_CLEAN = 300, 60
#: Lengths of the word beginnings that may vote, and the fewest toxic rows a mined voter fires on.
BEGINNINGS, SUPPORT = (4, 5, 6), 3
THRESHOLD = 0.7
#: Plain insults, each a voter.
INSULTS = (
    "asshole", "bastard", "bitch", "cabrón", "clown", "connard", "crétin", "disgusting", "dumb", "estúpido", "freak", "garbage", "gilipollas", "hate", "idiot", "idiota", "idiote", "imbecile", "imbécil", "jerk",
    "loser", "moron", "pathetic", "salaud", "scum", "stupid", "trash", "ugly", "worthless", "abschaum", "arschloch", "blöd", "dumm", "trottel",
)
#: Patterns, each a voter: shouting, repeated marks, letters hidden behind stars, an insult behind an address, an insult repeated.
_ANY = "|".join(sorted(INSULTS))
PATTERNS = {
    "shouting": r"(?:\b[A-ZÀ-Þ]{3,}\b\W+){2}\b[A-ZÀ-Þ]{3,}\b", "marks": r"[!?]{3,}", "stars": r"\b\w+\*{2,}\w*",
    "address": rf"(?i)\b(?:you|your|tu|toi|vous|du|ihr|tú|eres)\b(?:\W+\w+){{0,3}}?\W+(?:{_ANY})\b", "again": rf"(?i)\b({_ANY})\b.{{0,80}}\b\1\b",
}
_PATTERNS = {f"#{k}": re.compile(v, re.S) for k, v in PATTERNS.items()}
#: Before the name of a mined voter that votes for clean.
CLEAN = "-"
_WORDS = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """A text's distinct words (=word) and word beginnings (letters*), in lower case."""
    words = set(_WORDS.findall((text or "").lower()))
    out = {f"={w}" for w in words}
    for n in BEGINNINGS:
        out.update(f"{w[:n]}*" for w in words if len(w) >= n)
    return out


@dataclass
class Voters:
    """Which words, beginnings and patterns vote, for toxic or (behind CLEAN) for clean, and the place of each; one that doesn't fire abstains."""

    names: list[str]

    def __post_init__(self) -> None:
        place = {v.removeprefix(CLEAN): i for i, v in enumerate(self.names)}
        self.toxic = np.array([not v.startswith(CLEAN) for v in self.names])
        self.words = {v[1:]: i for v, i in place.items() if v[0] == "="}
        self.patterns = [(i, _PATTERNS[v].search) for v, i in place.items() if v[0] == "#"]
        self.starts = [(n, {v[:-1]: i for v, i in place.items() if v[0] not in "=#" and len(v) == n + 1}) for n in BEGINNINGS]
        self.starts = [(n, s) for n, s in self.starts if s]

    def fired(self, text: str | None) -> set[int]:
        words = set(_WORDS.findall((text or "").lower()))
        out = {self.words[w] for w in words & self.words.keys()}
        for n, starts in self.starts:
            out.update(starts[s] for s in {w[:n] for w in words} & starts.keys())
        out.update(i for i, found in self.patterns if text and found(text))
        return out


@dataclass
class LabelModel:
    """P(voter fires | class), the classes' prior, and how far each voter repeats others.

    Voters that fire together more often than their classes explain count less: voter j's evidence is divided by
    1 + the sum of its positive residual correlations above 0.1, estimated within classes by the current posterior.
    """

    rates: np.ndarray
    prior: float
    shared: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        weight = 1 / self.shared
        gain = (np.log(self.rates[1]) - np.log(self.rates[0])) * weight
        loss = (np.log1p(-self.rates[1]) - np.log1p(-self.rates[0])) * weight
        z = math.log(self.prior / (1 - self.prior)) + votes @ gain + (1 - votes) @ loss
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 15, toxic: np.ndarray | None = None) -> LabelModel:
    """Expectation maximisation; votes: rows x voters, of which the last is the given label itself, an error-prone voter. toxic: which voters vote for it (all)."""
    sign = np.ones(votes.shape[1], bool) if toxic is None else np.append(toxic, True)
    q = np.where(labels > 0, 0.9, 0.1)
    model = None
    for _ in range(rounds):
        mass = np.stack([1 - q, q])
        rates = (mass @ votes + 0.05) / (mass.sum(1, keepdims=True) + 1)
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        rates[1] = np.where(sign, np.maximum(rates[1], rates[0]), np.minimum(rates[1], rates[0]))  # a voter never speaks against its side
        rest = votes - (rates[1] * q[:, None] + rates[0] * (1 - q)[:, None])
        cov = rest.T @ rest / len(votes)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / spread[:, None] / spread[None, :]
        np.fill_diagonal(corr, 0)
        shared = 1 + np.where(corr > 0.1, corr, 0).sum(1)
        shared[-1] = 1
        model = LabelModel(rates, float(np.clip(q.mean(), 1e-3, 1 - 1e-3)), shared)
        q = model.posterior(votes)
    return model


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.03, rounds: int = 25) -> np.ndarray:
    """Logistic regression on posterior labels by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pen = np.full(len(w), ridge)
    pen[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pen), x.T @ (q - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Scorer:
    voters: Voters
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        hit = self.voters.fired(text)
        z = self.weights[list(hit)].sum() + self.weights[-2] * math.log1p(sum(self.voters.toxic[i] for i in hit)) + self.weights[-1]
        return float(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))


def inputs(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Votes, and the logarithm of how many are for toxic."""
    return np.hstack([votes, np.log1p(votes[:, toxic].sum(1, keepdims=True))])


def learnable(labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` labelled ids whose crc32 modulo 3 is not 1: doc_id, toxic."""
    known = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def mine(rows: DataFrame) -> list[str]:
    """The words and beginnings that toxic rows, or (behind CLEAN) clean ones, have significantly more often: G2 above what chance gives the best of all."""

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                seen[1 if toxic else 0].update(features(text))
            names = list(seen[0].keys() | seen[1].keys())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([seen[k][n] for n in names], pa.int64()) for k in (0, 1))], ["feature", "clean", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    found = checkpointed(found.where(f"t + c >= {SUPPORT}"))
    size = rows.agg(F.sum((F.col("toxic") == 0).cast("long")), F.sum((F.col("toxic") != 0).cast("long"))).first()
    clean, toxic = (size[0] or 0), (size[1] or 0)
    if not clean or not toxic:
        return []
    share = toxic / (clean + toxic)
    n = F.col("t") + F.col("c")
    part = lambda k, e: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * e))).otherwise(0.0)
    scored = found.withColumn("g", 2 * (part("t", share) + part("c", 1 - share)))
    least = 2 * math.log(max(2, found.count())) + 2
    sides = ((F.col("t") / toxic > 4 * F.col("c") / clean) & (F.col("t") >= SUPPORT), MINED, ""), ((F.col("c") / clean > 4 * F.col("t") / toxic) & (F.col("c") >= SUPPORT), MINED_CLEAN, CLEAN)
    return [mark + r.feature for side, most, mark in sides for r in scored.where(F.col("g") > least).where(side).orderBy(F.desc("g"), "feature").limit(most).collect()]


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Scorer:
    """Learns from at most `rows` labelled texts; only their voters' names and fired votes reach the driver.

    Without labels of both classes, the fixed voters decide with weights set beforehand.
    """
    ship(docs.sparkSession)
    chosen = checkpointed(learnable(labels, rows))
    train = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def like(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys = [min(xxhash.xxh3_64_intdigest(" ".join(w[i : i + 5])) >> 1 for i in range(max(1, len(w) - 4))) for w in ((t or "").split() for t in b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column("text"), b.column("toxic")], ["q_like", "text", "toxic"])

    # copies, and most near copies, share their least shingle: they are one piece of evidence
    train = train.select("text", "toxic").mapInArrow(like, "q_like long, text string, toxic int")
    train = train.groupBy("q_like").agg(F.min(F.struct((-F.col("toxic")).alias("t"), F.coalesce("text", F.lit("")).alias("text"))).alias("q_row"))
    train = checkpointed(train.select("q_row.text", (-F.col("q_row.t")).alias("toxic")))
    mined = mine(train)
    voters = Voters([*(f"={w}" for w in INSULTS), *_PATTERNS, *(v for v in mined if v[1:] not in INSULTS)])

    def vote(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(voters.fired(t)) for t in b.column("text").to_pylist()], pa.list_(pa.int32())), b.column("toxic")], ["hits", "toxic"])

    got = train.mapInArrow(vote, "hits array<int>, toxic int").collect()
    votes, given = np.zeros((len(got), len(voters.names) + 1)), np.array([r.toxic for r in got]) if got else np.zeros(0)
    for i, r in enumerate(got):
        votes[i, r.hits] = 1
    if not given.any() or given.all():
        return Scorer(voters, np.array([0.0 if v[0] == "#" else 4.0 for v in voters.names] + [0.5, -2.5]))
    votes[:, -1] = given
    order = np.lexsort(votes.T)  # sums then don't depend on the order of partitions
    votes, given = votes[order], given[order]
    q = fit_label_model(votes, given, toxic=voters.toxic).posterior(votes)
    return Scorer(voters, fit_linear(inputs(votes[:, :-1], voters.toxic), q))


def scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, held_out (crc32 of doc_id modulo 3 is 1; false for null), score, predicted.

    Null and empty texts get the score of a text on which no voter fires. One pass over whole texts, no shuffle.
    """
    scorer = fit(docs, labels, **options)

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = [scorer.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs with a score below THRESHOLD, all columns."""
    scorer, at = fit(docs, labels, **options), docs.columns.index("text")

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array([scorer.score(t) < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lambda it: tidied(run(it)), docs.schema)
