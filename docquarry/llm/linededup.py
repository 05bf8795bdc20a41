"""Line dedup: levelled sorted runs of line hashes, which each batch of documents is compared with and then joins."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.runtime import join_small, materialised, removed, shared_folder

#: A line counts if its key has this many code points, and goes if the key is found in this many documents.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches that a table is cut into, and runs of a level that are compacted into one of the next.
BATCHES, FANOUT = 8, 4
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashes(key: Column) -> list[Column]:
    """Two 64-bit hashes that differ in their seed: together they name a key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def key_holders(docs: DataFrame) -> DataFrame:
    """h1, h2, doc for every document (row) and each of its distinct keys that count; a null id stands below all others."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    got = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.explode(keys).alias("q_key"))
    return got.where(F.char_length("q_key") >= LEAST_CHARS).select(*hashes(F.col("q_key")), "doc")


@dataclass
class LineRuns:
    """An index of keys that grows by batches: runs (h1, h2, docs, holder) sorted by hash, a Parquet folder each, all bucketed alike.

    docs: documents of the run's batches that hold the key; holder: the document whose lines stay, which only the run
    of the first batch with that key tells. Batches come in the order in which documents are to win. A run of level 0 is
    one batch; FANOUT runs of a level are merged into one of the next, so a batch meets a few runs, and a key is
    rewritten once a level. Equal bucketing spares the joins and merges all shuffles of the runs; the hashes are spread
    evenly and every row is one key of one batch, so no bucket is hot. Runs lie in the shared folder and outlive executors.
    """

    spark: SparkSession
    buckets: int = 0
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)
    tables: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, rows: DataFrame, *parts: str) -> str:
        """A sorted and bucketed table; rows should already be dealt by hash into as many partitions as there are buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        writer = rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path)
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
        self.tables[name] = path
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        removed(self.spark, self.tables.pop(name))

    def live(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, docs, holder, a row per key. Keys that no run holds keep the batch's holder; of the others only the documents count."""
        new = batch
        for name in self.live():
            new = new.join(self.spark.table(name).select(*HASH).hint("merge"), [*HASH], "left_anti")
        known = new.select(*HASH, F.col("holder").alias("q_new"))
        run = batch.join(known.hint("merge"), [*HASH], "left").select(*HASH, "docs", F.col("q_new").alias("holder")) if self.levels else batch
        self.levels = self.levels or [[]]
        self.levels[0].append(self.write(run))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self.compact(level)

    def compact(self, level: int) -> None:
        """Merges a level's runs into one run of the next level."""
        merged = self.write(self.merged(self.levels[level]))
        for name in self.levels[level]:
            self.drop(name)
        self.levels[level] = []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(merged)

    def merged(self, names: list[str]) -> DataFrame:
        """h1, h2, docs, holder of several runs, a row per key: full joins of runs dealt alike."""
        out = None
        for name in names:
            run = self.spark.table(name)
            if out is None:
                out = run
                continue
            run = run.select(*HASH, F.col("docs").alias("q_docs"), F.col("holder").alias("q_holder"))
            total = F.coalesce("docs", F.lit(0)) + F.coalesce("q_docs", F.lit(0))
            out = out.join(run.hint("merge"), [*HASH], "full").select(*HASH, total.alias("docs"), F.coalesce("holder", "q_holder").alias("holder"))
        return out

    def close(self) -> None:
        for name in list(self.tables):
            self.drop(name)
        self.levels = []


def frequent_keys(docs: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """h1, h2, holder: keys found in at least least_docs documents, and the largest doc_id that holds each.

    The documents are cut into batches by falling doc_id (quantiles; any cut gives the same result). A key's documents are
    counted by task and batch before they are shuffled, once. Each batch is compared with the runs and then added to them.
    """
    spark = docs.sparkSession
    index = LineRuns(spark, fanout=fanout)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    held = key_holders(docs).withColumn("batch", sum((F.when(F.col("doc") <= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)))
    tallied = held.groupBy(*HASH, "batch").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("holder"))
    stage = index.write(tallied.repartition(index.buckets, *HASH), "batch")
    for b in range(len(cuts) + 1):
        index.add(spark.table(stage).where(F.col("batch") == b).drop("batch"))
    keys = materialised(index.merged(index.live()).where(F.col("docs") >= least_docs).select(*HASH, "holder"))
    index.close()
    return keys


def dropped_lines(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """doc, q_text (hash of the text), places: for each document that loses lines, their numbers from 0."""
    lines = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("q_text"), F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("place", "q_key"))
    lines = lines.where(F.char_length("q_key") >= LEAST_CHARS).select("doc", "q_text", "place", *hashes(F.col("q_key")))
    return join_small(lines, keys, [*HASH]).where("doc <> holder").groupBy("doc", "q_text").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """row: struct of all the columns of docs, whatever their names; kept: its text without the lines that another document keeps; n_lines, n_dropped.

    Each row is a document. Null and empty texts are one empty line, which never counts. A null doc_id stands below all
    others; rows with the id that keeps a key all keep its lines. Every line of a key in one document shares that
    document's fate. Equal rows are treated alike. An empty table gives no rows.
    """
    keys = frequent_keys(docs, **options)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.withColumn("doc", F.coalesce("row.doc_id", F.lit(-(1 << 63)))).withColumn("q_text", F.xxhash64("row.text"))
    out = row.join(dropped_lines(docs, keys), ["doc", "q_text"], "left")
    lines = lines_of(F.col("row.text"))
    rest = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("places")), lambda i: F.get(ls, i)), "\n"))[0]  # the lines are split once
    kept = F.when(F.col("places").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(rest)
    return out.select("row", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"))


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_lines (before dropping), n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"), **options)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
m AS (SELECT k.rid, k.doc_id, pos, line, f.key IS NOT NULL AND f.holder IS DISTINCT FROM k.doc_id AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid, doc_id
"""
