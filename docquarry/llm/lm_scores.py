"""Language-model scores of documents: a word-count base and a trained attention model."""

from __future__ import annotations

import math
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import attention as at
from docquarry.llm.heads import FLUSH, frequent, tallied
from docquarry.llm.packing import TOKENIZER, word_encoder
from docquarry.llm.tokens import Remembered, kept_for, tokenizer
from docquarry.runtime import materialised, ship

#: Frequent words that every task holds, with their counts; the others' are joined.
HEAD_WORDS = 150_000
#: The most frequent pairs of an id and the one before it in its word whose probability is kept; the others fall back on their class.
PAIRS = 400_000
#: Windows in a piece of a training document, so that long documents are dealt over shards.
PIECE_WINDOWS = 100
#: Ids of training text per shard of local descent; the shards' models are averaged. Their number grows with the text.
SHARD_IDS = 4_000_000
#: Models are summed as whole numbers of this fraction, so that sums don't depend on the order of shards.
_FRACTION = 1 << 16
WORDS_KEPT = 150_000


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % 7 == 2, F.lit(False))


def split(text: str | None) -> list[bytes]:
    """Words: runs other than white space (20, 09 to 0D), with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """part (a word, binary), n over all texts."""
    return tallied(texts.select("text"), lambda: split, "binary")


def _summed(counts: DataFrame, name: str, size: int, tally: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over batches of counted words of tally(their ids, their counts), a table of `size` numbers: a task shuffles one row per cell at most."""

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = word_encoder(name, "lm"), np.zeros(size, np.int64)
        for b in it:
            words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            parts = [np.frombuffer(encode(w.decode()), np.uint32) for w in words]
            if parts:
                total += tally(parts, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(size, np.int64)
    got = counts.select("part", "n").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


def id_counts(counts: DataFrame, name: str, size: int) -> np.ndarray:
    """How often each subword id occurs in the counted words."""
    return _summed(counts, name, size, lambda parts, n: np.bincount(np.concatenate(parts), np.repeat(n, [len(p) for p in parts]), size).astype(np.int64))


def step_counts(counts: DataFrame, name: str, layout: at.Layout) -> np.ndarray:
    """at.word_steps() of all counted words, rare ones included."""
    return _summed(counts, name, (layout.begin + 1) * (at.CLASSES + 1) + at.CLASSES, lambda parts, n: at.word_steps(parts, n, layout))


def pair_counts(counts: DataFrame, name: str, layout: at.Layout, final: np.ndarray) -> DataFrame:
    """part (a key of at.Inside), n over all counted words. Each task adds up its pairs before the shuffle."""

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(name, "lm")
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["part", "n"])
        for b in it:
            more, times = at.word_pairs([np.frombuffer(encode(w.decode()), np.uint32) for w in b.column(0).to_pylist()], b.column(1).to_numpy(), layout, final)
            every, k = np.unique(np.concatenate([keys, more]), return_inverse=True)
            keys, n = every, np.bincount(k, np.concatenate([n, times]), len(every)).astype(np.int64)
            if len(keys) > FLUSH:
                yield rows()
                keys, n = keys[:0], n[:0]
        if len(keys):
            yield rows()

    return counts.select("part", "n").mapInArrow(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))


def inside(counts: DataFrame, name: str, layout: at.Layout, log_id: np.ndarray, final: np.ndarray, end: int, n_texts: int, most: int = PAIRS) -> at.Inside:
    """The id behind an id inside a class, by the pairs of all counted words; the `most` most frequent have a probability of their own."""
    found = frequent(materialised(pair_counts(counts, name, layout, final)), most)
    found[len(final) * len(final) + end] = n_texts
    return at.Inside.of(np.array(list(found.keys()), np.int64), np.array(list(found.values()), np.int64), log_id, layout.cls, final)


def _bytes_ids(name: str):
    """Ids by words in bytes."""
    encode = word_encoder(name, "lm")
    return kept_for("lm", f"ids:{name}", lambda: Remembered(lambda w: encode(w.decode())))


def train_pieces(train: DataFrame, name: str, end: int, size: int, shards: int) -> DataFrame:
    """shard, id, place, opens, ids: all ids of every training document and its end, cut into pieces that score each id once.

    A piece inside a text repeats the CONTEXT + 1 ids before it. Ids take two bytes where the vocabulary's size allows.
    """
    kind = "<u2" if size <= 1 << 16 else "<u4"
    step, lead, stop = PIECE_WINDOWS * at.SCORED, at.CONTEXT + 1, array("I", [end]).tobytes()

    def pieces(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _bytes_ids(name)
        for b in it:
            for lo in range(0, b.num_rows, 64):
                rows, part = [], b.slice(lo, 64)
                for ident, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids_of.rest()
                    ids = np.frombuffer(b"".join(map(ids_of.__getitem__, split(text))) + stop, np.uint32).astype(kind)
                    for place in range(0, len(ids), step):
                        shard = crc32(b"%d %d" % (ident or 0, place)) % shards
                        rows.append((shard, ident, place, place == 0, ids[max(0, place - lead) : place + step].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["shard", "id", "place", "opens", "ids"])

    return train.select("doc_id", "text").mapInArrow(pieces, "shard int, id long, place long, opens boolean, ids binary")


def train_shards(train: DataFrame, model: at.Model, layout: at.Layout, name: str, end: int, shards: int) -> at.Model:
    """Descends from model on every shard's windows and averages the results by their numbers of windows.

    The windows tile every training document, as those of scoring do. A task holds a shard's ids, some SHARD_IDS.
    """
    size = len(layout.cls)
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def descend(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: int, pieces: list) -> pa.RecordBatch:
            tiles = at.Tiles.of(pieces, layout)
            got = np.rint(at.train_tiles(model, tiles, np.random.default_rng(shard)).flat().astype(np.float64) * _FRACTION).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got * len(tiles.start)), pa.array(np.full(len(got), len(tiles.start)))], ["place", "w", "n"])

        now, held = None, []
        for b in it:
            for shard, opens, raw in zip(*(b.column(c).to_pylist() for c in ("shard", "opens", "ids")), strict=True):
                if shard != now and held:
                    yield done(now, held)
                    held = []
                now = shard
                held.append((opens, np.frombuffer(raw, kind)))
        if held:
            yield done(now, held)

    dealt = train_pieces(train, name, end, size, shards).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "id", "place", "ids")
    sums = dealt.mapInArrow(descend, "place int, w long, n long").groupBy("place").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toArrow()
    if not sums.num_rows:
        return model
    out = np.empty(sums.num_rows)
    out[sums.column("place").to_numpy()] = sums.column("w").to_numpy() / sums.column("n").to_numpy() / _FRACTION
    return model.like(out)


def lm_scores(docs: DataFrame, name: str = TOKENIZER, head_words: int = HEAD_WORDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens of the base are words and an end. Null text is empty: its end alone is scored. A null id counts as not held out;
    repeated rows get a row each; an empty table gives none. Counts cover all training documents. A text is held by a task as
    words and ids: some 100 bytes a word.
    score is the attention model's log10 probability of the text's subword ids and an end.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    train = docs.where(~held_out(F.col("doc_id")))
    counts = materialised(word_counts(train))
    n_texts = docs.select("doc_id").where(~held_out(F.col("doc_id"))).count()
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_train, n_distinct = total + n_texts, distinct + (n_texts > 0)
    head = frequent(counts, head_words)

    vocabulary = tokenizer(name).get_vocab()
    size, end = max(vocabulary.values()) + 1, vocabulary["<|endoftext|>"]
    final = np.zeros(size, bool)
    final[[i for v, i in vocabulary.items() if v.endswith("</w>") or i >= 49406]] = True
    ids = id_counts(counts, name, size)
    ids[end] += n_texts
    layout = at.Layout.of(ids, final)
    within = inside(counts, name, layout, at.log_id_given_class(ids, layout.cls), final, end, n_texts)
    start = at.begin(at.follows(step_counts(counts, name, layout), layout, end, n_texts), np.random.default_rng(7))
    model = train_shards(train, start, layout, name, end, max(1, round(int(ids.sum()) / SHARD_IDS)))

    floor = math.log10(n_train + n_distinct + 1) if n_train + n_distinct else 0.0
    head_logs = {w: math.log10(n + 1) - floor for w, n in head.items()}
    end_log = math.log10(n_texts + 1) - floor
    token = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast((model, layout, within, head_logs))  # tables of fixed size, at most PAIRS pairs and head_words words

    def score(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lay, inner, logs = sent.value
        encode, find = word_encoder(name, token), logs.get
        both = kept_for(token, "ids and logs", lambda: Remembered(lambda w: (encode(w.decode()), find(w)), WORDS_KEPT))
        stop = array("I", [end]).tobytes()
        row = TaskContext.get().partitionId() << 40
        for b in it:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts, out, rare = [], [], []
                for ident, text, held in zip(*(part.column(k).to_pylist() for k in ("doc_id", "text", "held_out")), strict=True):
                    words = split(text)
                    both.rest()
                    entries = list(map(both.__getitem__, words))
                    texts.append(np.frombuffer(b"".join([e[0] for e in entries]) + stop, np.uint32))
                    found = [e[1] for e in entries]
                    known = [x for x in found if x is not None]
                    if len(known) < len(words):
                        rare += [(row, w, n) for w, n in Counter([w for w, x in zip(words, found, strict=True) if x is None]).items()]
                    out.append((row, ident, held, len(words) + 1, len(known) + (n_texts > 0), sum(known) + end_log))
                    row += 1
                lp = at.log_probs(m, lay, inner, texts)
                whole = [r + (s,) for r, s in zip(out, lp.tolist(), strict=True)]
                # a document's own row carries a key that no word has, so that it passes the join by words evenly
                n, k = len(whole), len(rare)
                keys = [b" %d" % r[0] for r in whole] + [r[1] for r in rare]
                cols = [[r[0] for r in whole] + [r[0] for r in rare], keys, [0] * n + [r[2] for r in rare], *([r[i] for r in whole] + [None] * k for i in range(1, 7))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["row", "part", "tf", "doc_id", "held_out", "n_tokens", "known", "base", "score"])

    scored = docs.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(score, "row long, part binary, tf long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double")
    joined = scored.join(counts, "part", "left")
    gain = F.when(F.col("tf") > 0, F.col("tf") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(floor))).otherwise(F.lit(0.0))
    known = F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(F.lit(0))
    sums = joined.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "score")], (F.sum(F.coalesce("known", F.lit(0))) + F.sum(known)).alias("n_known"), (F.sum(F.coalesce("base", F.lit(0.0))) + F.sum(gain)).alias("base_score"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
