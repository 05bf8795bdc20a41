"""The n-gram Jaccard join: classes of documents that PartEnum signatures, verified exactly, link."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.bytewords import chunks, mix
from docquarry.llm.components import components
from docquarry.llm.partenum import Scheme, folded, forest, linked, most_apart, near_pairs, sets, sketch
from docquarry.runtime import join_small, released, removed, ship, stored, tidied

#: Tasks over which the copies of one text are dealt at least.
SALTS = 64
#: Members of a signature that a task holds at once, twice where two blocks meet; larger groups are compared block by block, each pair of blocks on its own.
GROUP_ROWS = 4096
#: What a group costs besides its pairs, in pairs.
GROUP_COST = 4000.0
#: Signatures of a bucket, about: the number of buckets grows with the shingles.
BUCKET_KEYS = 1 << 19
#: Signatures that a task gathers before it deals them: at least so many, and so many a bucket.
DEALT_KEYS, DEALT_EACH = 1 << 18, 64
#: Likely pairs held before they are thinned to a forest, and equal sets that a task remembers to have signed.
FOREST_PAIRS, SIGNED = 500_000, 200_000


def _summary(batches: Iterable[pa.RecordBatch], n: int, scheme: Scheme) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, t in chunks(batch.column(1), lower=True):
            found = sets(t, n)
            size = np.array([len(s) for s in found], np.int64)
            ones = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64))) for s in found]
            one, two = (np.array([x[k] for x in ones], np.uint64).view(np.int64) for k in (0, 1))
            parity = [sketch(s, int(most_apart(2 * len(s), scheme.num, scheme.den))) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(one), pa.array(two), pa.array(parity, pa.binary())], ["id", "n", "h1", "h2", "sketch"])


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers as planes of bytes: those that hardly change compress to nothing."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(raw: pa.Scalar, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw.as_buffer(), np.uint8).reshape(8, -1).T).view(kind).ravel()


def _signatures(batches: Iterable[pa.RecordBatch], n: int, scheme: Scheme, buckets: int) -> Iterator[pa.RecordBatch]:
    """Per bucket a row of many signatures, of 56 bits, and of their documents' ids as differences."""
    seen: set[tuple[int, int]] = set()  # a task's equal sets sign once: others reach their class by its hashes
    keys: list[np.ndarray] = []
    ids: list[np.ndarray] = []

    def dealt() -> pa.RecordBatch:
        key, ident = np.concatenate(keys) >> np.uint64(8), np.concatenate(ids)
        bucket = (key % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        cuts[-1] = len(order)
        full = np.flatnonzero(np.diff(cuts))
        key, ident = key[order], ident[order]
        keys.clear(), ids.clear()
        rows = [(_planes(key[cuts[k] : cuts[k + 1]]), _planes(np.diff(ident[cuts[k] : cuts[k + 1]], prepend=0))) for k in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], ["bucket", "keys", "ids"])

    held = 0
    for batch in batches:
        if len(seen) > SIGNED:
            seen.clear()
        for lo, hi, t in chunks(batch.column(1), lower=True):
            idents = batch.column(0).slice(lo, hi - lo).to_numpy()
            for i, s in enumerate(sets(t, n)):
                if len(s) and (own := (len(s), int(mix(s).sum(dtype=np.uint64)))) not in seen:
                    seen.add(own)
                    keys.append(scheme.signatures(s))
                    ids.append(np.full(len(keys[-1]), idents[i], np.int64))
                    held += len(keys[-1])
            if held >= max(DEALT_KEYS, DEALT_EACH * buckets):
                yield dealt()
                held = 0
    if held:
        yield dealt()


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's signatures, those that several documents have: a row per document but the first.

    Of signatures with the same documents one stays. e and f tell the documents of those that more than two have.
    """
    keys, ids = [], []
    for b in batches:
        keys += [_unplaned(k, np.uint64) for k in b.column(1)]
        ids += [np.cumsum(_unplaned(i, np.int64)) for i in b.column(2)]
    if not keys:
        return
    key, ident = np.concatenate(keys), np.concatenate(ids)
    del keys, ids
    order = np.argsort(key)
    key = key[order]
    same = np.concatenate([[False], key[1:] == key[:-1], [False]])
    several = same[1:] | same[:-1]
    key, ident = key[several].view(np.int64), ident[order[several]]
    order = np.lexsort((ident, key))
    key, ident = key[order], ident[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])  # rows that share an id are one document
    key, ident = key[new], ident[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return
    size = np.diff(np.append(first, len(key)))
    e, f = (np.bitwise_xor.reduceat(mix(ident.view(np.uint64) ^ np.uint64(salt)), first) for salt in (0, 0xD6E8FEB86659FD93))
    order = np.lexsort((f, e, size))
    e, f, g = e[order], f[order], size[order]
    once = np.concatenate([[True], (e[1:] != e[:-1]) | (f[1:] != f[:-1]) | (g[1:] != g[:-1])]) & (g > 1)
    order, e, f, g = order[once], e[once].view(np.int64), f[once].view(np.int64), g[once]
    for lo in range(0, len(order), 1 << 14):  # a signature's rows come as slices of its documents
        some = slice(lo, lo + (1 << 14))
        times, start = g[some] - 1, first[order[some]]
        at = np.repeat(start + 1 - (np.cumsum(times) - times), times) + np.arange(times.sum())
        marks = (np.where(times > 1, x[some], 0) for x in (e, f))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[at], ident[at], np.repeat(ident[start], times), np.repeat(times, times), *(np.repeat(m, times) for m in marks))], ["key", "id", "lead", "places", "e", "f"])


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of one key (the first columns) after another, of batches sorted by it; runs of a key are kept as they came."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[i] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _thinned(part: np.ndarray, held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    i, j, slack = (np.concatenate(x) for x in zip(*held, strict=True))
    chosen = forest(part, i, j, slack)
    return i[chosen], j[chosen], slack[chosen]


def _verified(pairs: DataFrame, docs: DataFrame, summary: DataFrame, n: int, scheme: Scheme, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Those of the distinct pairs (u, v) that link: by sizes and sketches first, then by the whole sets. held: stores a table."""
    num, den = scheme.num, scheme.den

    def may(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            c = {k: b.column(k).to_pylist() for k in b.schema.names}
            ok = [min(m, k) * den >= max(m, k) * num and int(np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum()) <= most_apart(m + k, num, den) for m, k, x, y in zip(c["un"], c["vn"], c["us"], c["vs"], strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    side = lambda x: summary.select(F.col("id").alias(x), F.col("n").alias(f"{x}n"), F.col("sketch").alias(f"{x}s"))
    likely = held(pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(may, "u long, v long").distinct())
    needed = held(likely.select(F.col("u").alias("id")).union(likely.select("v")).distinct())

    def whole(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, t in chunks(batch.column(1), lower=True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets(t, n)], pa.binary())], ["id", "items"])

    texts = join_small(docs.select(F.col("doc_id").alias("id"), "text"), needed, "id", "left_semi").mapInArrow(whole, "id long, items binary")

    def test(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den) for x, y in zip(b.column("ui"), b.column("vi"), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    item = lambda x: texts.select(F.col("id").alias(x), F.col("items").alias(f"{x}i"))
    return held(likely.join(item("u"), "u").join(item("v"), "v").mapInArrow(test, "u long, v long"))


def link_classes(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    Documents link when den * intersection >= num * union of their sets of n-word shingles (lower-cased A-Z; the
    whole sequence where there are fewer words). Empty sets link with nothing; a null doc_id keeps a null component;
    rows that share a doc_id are one node. The result is exact, whatever the sizes of groups:

    1. Equal sets are joined by two 64-bit hashes. Each task signs a set once, so copies don't multiply.
    2. Each signature's documents are held against its first one; what links is found exactly.
    3. Signatures with the same documents count as one, and those of a family that shares documents are one group where that makes
       fewer pairs. Where documents of a group are then still in different classes, its pairs across classes are compared
       inside the task by parity sketches, which bound the difference from below. Of those not ruled out, the likeliest that would
       join the classes are tested exactly first, where a group has more of them than rows; then all that are left across its classes are.
    Signatures, not documents, are dealt to tasks; no pairs within a class are ever made in step 3.
    """
    ship(docs.sparkSession)
    spark, scheme = docs.sparkSession, Scheme(num, den)
    paths: list[str] = []

    def held(df: DataFrame) -> DataFrame:
        out, path = stored(df)
        paths.append(path)
        return out

    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id is not null")
    summary, _ = stored(docs.mapInArrow(lambda it: tidied(_summary(it, n, scheme)), "id long, n long, h1 long, h2 long, sketch binary"))
    sizes = summary.where("n > 0 and id is not null")
    first = sizes.groupBy("h1", "h2", "n").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("q_same")).where("q_same > 1").drop("q_same")
    salted = first.withColumn("q_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a hot class's rows meet its first one in SALTS tasks
    copies = sizes.select(F.col("id").alias("u"), "h1", "h2", "n", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("q_salt")).join(salted, ["h1", "h2", "n", "q_salt"]).select("u", "v").where("u <> v")

    shingles = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(spark.sparkContext.defaultParallelism, round(shingles / BUCKET_KEYS))
    signed = known.mapInArrow(lambda it: tidied(_signatures(it, n, scheme, buckets)), "bucket int, keys binary, ids binary")
    shared, shared_path = stored(signed.repartitionById(buckets, F.col("bucket")).mapInArrow(lambda it: tidied(_shared(it)), "key long, id long, lead long, places long, e long, f long"))
    released(spark)  # the signatures' shuffle, the largest of all, is not needed beyond this
    stars = held(shared.select(F.col("id").alias("u"), F.col("lead").alias("v")).distinct())
    edges = held(copies.unionByName(_verified(stars, known, sizes, n, scheme, held)))
    released(spark)
    found = components(edges)

    # keys with the same members say the same: of each set of members, one key is compared
    several = shared.where("places > 1").groupBy("places", "e", "f").agg(F.min("key").alias("key")).select("key")
    members = held(shared.where("places > 1").join(several, "key", "left_semi").select("key", "id", "lead", "places"))
    removed(spark, shared_path)
    released(spark)
    # where signatures that share documents have more pairs among them than their documents have, these are compared as one group
    family = components(members.select(F.col("id").alias("u"), F.col("lead").alias("v")))
    of_lead = family.select(F.col("id").alias("lead"), F.col("component").alias("family"))
    keys = members.select("key", "lead", (F.col("places") + 1).alias("g")).distinct().join(of_lead, "lead").select("key", "lead", "family", "g")
    work = keys.groupBy("family").agg(F.sum(F.col("g").cast("double") * F.col("g") + GROUP_COST).alias("work"))
    merged = family.groupBy(F.col("component").alias("family")).agg(F.count(F.lit(1)).alias("m")).join(work, "family").where(F.col("m").cast("double") * F.col("m") <= F.col("work")).select("family")
    single = held(keys.join(merged, "family", "left_anti").select("key", "lead"))
    alone = members.select("key", "id").join(single.select("key"), "key", "left_semi").unionByName(single.select("key", F.col("lead").alias("id")))
    members = held(alone.unionByName(family.join(merged, F.col("component") == F.col("family"), "left_semi").select(F.col("component").alias("key"), "id")))
    released(spark)
    tried = stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    def across(it: Iterable[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of each group's rows: all, or, of a group with more of them than rows, a forest and its key, for the next round."""

        def rows(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[i], ids[j])), pa.array(np.minimum(ids[i], ids[j])), pa.nulls(len(i), pa.int64())], ["u", "v", "rest"])

        for g in _groups(it, 3):
            ids, part, size, half = (g.column(k).to_numpy() for k in ("id", "component", "n", "block"))
            if (part == part[0]).all():
                continue
            likely: list[tuple[np.ndarray, ...]] = []
            made = 0
            for found in near_pairs(size, g.column("sketch").to_pylist(), part, half, num, den):
                if whole:
                    yield rows(ids, *found[:2])
                    continue
                likely.append(found)
                made += len(found[0])
                if sum(len(h[0]) for h in likely) > FOREST_PAIRS:  # a pair outside a part's forest is in no forest of the whole
                    likely = [_thinned(part, likely)]
            if made > len(ids):
                yield rows(ids, *_thinned(part, likely)[:2])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([g.column("key")[0].as_py()])], ["u", "v", "rest"])
            else:
                for found in likely:
                    yield rows(ids, *found[:2])

    for whole in (False, True):  # what most likely joins the classes first, so that few pairs are left to test
        named = held(members.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
        big = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("blocks")).where("blocks > 1")
        rest = join_small(named, held(big), "key", "left").where("a is null or a <> b").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rest = rest.join(sizes.select("id", "n", "sketch"), "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        cell = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(F.least(c, F.col("block")).alias("x"), F.greatest(c, F.col("block")).alias("y"))))
        rest = rest.withColumn("cell", cell).select("key", "cell.x", "cell.y", "block", "id", "component", "n", "sketch")
        said = held(rest.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(partial(across, whole=whole), "u long, v long, rest long").distinct())
        released(spark)
        more = held(said.where("u is not null").select("u", "v").join(tried, ["u", "v"], "left_anti"))
        late = _verified(more, known, sizes, n, scheme, held)
        if not late.isEmpty():
            found = components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(late))
        left = said.where("rest is not null").select(F.col("rest").alias("key")).distinct()
        if whole or left.isEmpty():
            break
        tried, members = tried.unionByName(more), held(join_small(members, held(left), "key", "left_semi"))
    for path in paths:
        removed(spark, path)
    return summary.select("id", "n").join(found, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose doc_id is its class's smallest; of rows that share a doc_id, all stay. Null ids stay."""
    dropped = link_classes(docs, n, num, den).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


#: link_classes() in DuckDB: all pairs that share a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT r.id, e.v FROM r JOIN e ON r.other = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id
"""
