"""SpotSigs fingerprints: chains of content words that follow common words, and the chains of all words."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.components import components
from docquarry.runtime import checkpointed, ship

#: Anchors, common words of English, French, German and Spanish.
ANCHORS = frozenset(
    "a an and are as at be but by can do for from had has have he his i in is it its not of on or she that the their there they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur lui mais ne nous ou par pas plus pour que qui sa se ses son sur un une vous "
    "aber als auch auf aus bei das dem den der die ein eine einen einer es für hat ich im ist mit nach nicht sich sie sind so und uns von vor war wie wir zu zum zur "
    "al como con del el ella ellos era esta este fue ha hay lo los las más muy no o para pero por se sin sobre su sus te tu una uno unos y ya".split()
)
#: Content words in a chain.
CHAIN = 2
_WORDS = re.compile(r"\w+")
_UINT32 = np.dtype("<u4")


def signatures(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's spots: a common word and the next CHAIN content words.

    Every text also gives the chains that start at each word (shorter at its end), so that short texts, lists and other
    languages have signatures and likeness does not depend on how many spots a text has; one without words gives a
    signature of its characters, an empty one none.
    """
    words = _WORDS.findall(text.lower())
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - CHAIN
    chains = {f"{w} {' '.join(content[k : k + CHAIN])}" for w, k in spots if k <= last}
    chains.update(" ".join(words[k : k + CHAIN + 1]) for k in range(len(words)))
    if not chains and text:
        chains = {text}
    return np.unique(np.array([xxhash.xxh32_intdigest(c) for c in chains], _UINT32))


def encode(items: np.ndarray) -> str:
    return base64.b64encode(items.astype(_UINT32).tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), _UINT32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Texts are near copies from a Jaccard similarity of NEAR / 100.
NEAR = 80


def partition_starts(num: int = NEAR, most: int = 1 << 31) -> list[int]:
    """The least length of each partition of set lengths: each a factor 100 / num above the last, so that sets of that similarity lie in one partition or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 100 // num + 1))
    return out


_STARTS = partition_starts()


def partition_of(n: int) -> int:
    """The partition of sets with n signatures; -1: none."""
    return bisect.bisect_right(_STARTS, n) - 1


def links(a: np.ndarray, b: np.ndarray, num: int = NEAR) -> bool:
    """Whether sorted sets have a Jaccard similarity of num / 100 or more: neighbouring partitions first, then lengths, then
    the overlap from the least signature on, until what is left can't reach the bound."""
    if not len(a) or not len(b) or abs(partition_of(len(a)) - partition_of(len(b))) > 1 or min(len(a), len(b)) * 100 < num * max(len(a), len(b)):
        return False
    need, both = -(-num * (len(a) + len(b)) // (100 + num)), 0
    for k in range(4):
        x, y = (s[np.searchsorted(s, k << 30) : np.searchsorted(s, (k + 1) << 30)] for s in (a, b))
        both += len(np.intersect1d(x, y, assume_unique=True))
        end = (k + 1) << 30
        if both + min(len(a) - np.searchsorted(a, end), len(b) - np.searchsorted(b, end)) < need:
            return False
    return both >= need


def edit(text: str, other: str) -> str:
    """text with its last third replaced by as much of other's beginning, or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long, length_partition int, edited_links boolean"


def _row(ident, text: str, own: np.ndarray, after: str, after_own: np.ndarray) -> tuple:
    changed = edit(text, after)
    marks = own if changed == text else signatures(changed)
    return ident, len(text), hashlib.sha256(changed.encode()).hexdigest(), encode(own), encode(marks), likeness(own, marks), likeness(own, after_own), len(own), partition_of(len(own)), links(own, marks)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, in order, with the next bucket's first row behind; gives a row for each of the bucket's own."""
    held: tuple | None = None  # bucket, id, text, signatures of a row whose next is not known yet
    for b in batches:
        rows = []
        for bucket, later, ident, text in zip(*(b.column(k).to_pylist() for k in ("q_bucket", "q_later", "doc_id", "text")), strict=True):
            if later and (held is None or held[0] != bucket):
                continue  # a further copy of the next bucket's first id
            own = signatures(text)
            if held is not None and held[0] == bucket:
                rows.append(_row(*held[1:], text, own))
            held = None if later else (bucket, ident, text, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in _OUT.split(", ")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures, length_partition, edited_links.

    length_partition is that of the text's set of signatures (-1: empty); edited_links tells whether the edited text is a near copy, by
    partitions and pruned Jaccard, as near_duplicates() links texts.

    The next document is that with the next smaller doc_id; after the last comes the first. Null texts count as empty, null
    ids come last, and rows with equal ids are ordered by their texts. A single row is its own next; an empty table gives no rows.

    Texts are shuffled once: quantiles of doc_id cut the order into buckets, each bucket is sorted in its task, and the
    row that opens a bucket is also sent to the bucket before, where it closes the run.
    """
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    table = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # ids at or above the largest cut are bucket 0, null ids the last
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(table, lambda c: c > F.col("doc_id"))))
    firsts = ids.select("doc_id", place.alias("b")).groupBy("b").agg(F.max("doc_id").alias("f")).orderBy("b").collect()
    if not firsts:
        return spark.createDataFrame([], _OUT)
    before = {r.b: firsts[k - 1].b for k, r in enumerate(firsts)}  # the bucket before, around the end
    opens = F.array(*[F.struct(F.lit(r.b).alias("b"), F.lit(r.f).cast("long").alias("f"), F.lit(before[r.b]).alias("to")) for r in firsts])
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place.alias("q_own"))
    leads = F.transform(F.filter(opens, lambda o: (o["b"] == F.col("q_own")) & o["f"].eqNullSafe(F.col("doc_id"))), lambda o: F.struct(o["to"].alias("q_bucket"), F.lit(1).alias("q_later")))
    sent = placed.withColumn("q_to", F.explode(F.concat(F.array(F.struct(F.col("q_own").alias("q_bucket"), F.lit(0).alias("q_later"))), leads)))
    order = ["q_bucket", "q_later", F.desc_nulls_last("doc_id"), "text"]
    dealt = sent.select("q_to.q_bucket", "q_to.q_later", "doc_id", "text").repartitionById(len(cuts) + 1, F.col("q_bucket"))
    return dealt.sortWithinPartitions(*order).mapInArrow(_runs, _OUT)


def near_duplicates(docs: DataFrame, num: int = NEAR) -> DataFrame:
    """Per row: doc_id, component_id, over links of Jaccard num / 100 and more between signature sets.

    Null and empty texts have no signatures and link with nothing; null ids keep a null component; rows that share an id are one node;
    an empty table gives no rows.

    Rows of equal sets are classes first. Each class's representative lists, in its length partition (and the next one if a partner may lie
    there), the signatures of its rarest-first prefix: any linked pair shares one of them. Lists are joined through their first member;
    members of a list that stay in different classes are then compared, where their lengths allow a link.
    """
    ship(docs.sparkSession)

    def sign(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [signatures(t or "") for t in b.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys), pa.array([len(s) for s in found], pa.int32()), pa.array([s.tolist() for s in found], pa.list_(pa.int64()))], ["id", "key", "n", "items"])

    def test(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = [links(np.array(x, _UINT32), np.array(y, _UINT32), num) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    sets = checkpointed(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(sign, "id long, key string, n int, items array<long>").where("n > 0"))
    first = sets.groupBy("key").agg(F.min("id").alias("v"))
    copies = sets.select(F.col("id").alias("u"), "key").join(first, "key").where("u <> v").select("u", "v")
    reps = checkpointed(sets.join(first, "key").where("id = v").select("v", "n", "items").dropDuplicates(["v"]))
    items = reps.select("v", "n", F.explode("items").alias("item"))
    ranked = items.join(items.groupBy("item").count(), "item").groupBy("v", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "item"))), lambda x: x["item"]).alias("rare"))
    starts = F.array(*[F.lit(x).cast("long") for x in partition_starts(num)])
    own = F.size(F.filter(starts, lambda x: x <= F.col("n"))) - 1
    bands = F.when(F.col("n") * 100 >= F.get(starts, own + 1) * num, F.array(own, own + 1)).otherwise(F.array(own))
    prefix = F.slice("rare", F.lit(1), F.col("n") - F.ceil(F.col("n") * num / 100).cast("int") + 1)
    listed = checkpointed(ranked.select("v", "n", F.explode(bands).alias("band"), prefix.alias("prefix")).select("v", "n", "band", F.explode("prefix").alias("item")))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda x, y: reps.select(F.col("v").alias(x), F.col("items").alias(y))
        return pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").mapInArrow(test, "u long, v long")

    lead = listed.groupBy("band", "item").agg(F.min("v").alias("lead"))
    stars = listed.join(lead, ["band", "item"]).where("v <> lead").select(F.col("v").alias("u"), F.col("lead").alias("v")).distinct()
    edges = checkpointed(copies.unionByName(verified(stars)))
    found = checkpointed(components(edges))
    named = listed.join(found, F.col("v") == F.col("id"), "left").select("band", "item", "v", "n", F.coalesce("component", "v").alias("c"))
    open_lists = named.groupBy("band", "item").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("band", "item")
    rest = named.join(open_lists, ["band", "item"], "left_semi")
    other = rest.select("band", "item", F.col("v").alias("u"), F.col("c").alias("d"), F.col("n").alias("m"))
    near = (F.least("m", "n") * 100 >= F.greatest("m", "n") * num) & (F.col("c") < F.col("d"))
    late = verified(rest.join(other, ["band", "item"]).where(near).select("u", "v").distinct())
    found = components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(late))
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
