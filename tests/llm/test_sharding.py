import zlib
from collections import Counter

from pyspark.sql import functions as F

from docquarry.llm import hilbert


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        n = 1 << bits
        cells = spark.range(n**dims)
        levels = [(F.floor(F.col("id") / n**j) % n).cast("int") for j in range(dims)]
        rows = sorted(cells.select(hilbert.curve_index(levels, bits).alias("h"), *levels).collect())
        assert [r[0] for r in rows] == list(range(n**dims))
        assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:], strict=True)) == 1 for x, y in zip(rows, rows[1:], strict=False))


def test_laws(small, odd, empty):
    for df, k in ((small, 40), (odd, 5)):
        rows = hilbert.document_shards(df, k).collect()
        texts = Counter((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in df.collect())
        assert Counter((r.doc_id, r.text_crc32, r["size"]) for r in rows) == texts
        per = Counter(r.shard for r in rows)
        assert max(per.values()) - min(per[s] for s in range(k)) <= 1
        for s in per:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
        ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
        assert [r.curve for r in ordered] == sorted(r.curve for r in rows)
    sized = hilbert.document_shards(small, 10, "bytes").collect()
    total, most = sum(r["size"] for r in sized), max(r["size"] for r in sized)
    per = Counter()
    for r in sized:
        per[r.shard] += r["size"]
    assert all(abs(per[s] - total / 10) <= most for s in range(10))
    assert hilbert.document_shards(empty).count() == 0
    assert hilbert.document_shards(empty, law="bytes").count() == 0


def test_runs_are_clustered(small):
    """Shards cover fewer language and length values than dealing by id would."""
    rows = hilbert.document_shards(small, 10).join(small.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    spread = lambda key: sum(len({r.lang for r in rows if key(r) == s}) for s in range(10))
    assert spread(lambda r: r.shard) < spread(lambda r: r.doc_id % 10)


def test_shards_against_brute_force(small, odd):
    """Shard and slot of every document, by sorting all of them by curve, id and checksum and cutting the list into equal runs."""
    for df, k in ((small, 40), (odd, 5), (small, 7)):
        rows = hilbert.document_shards(df, k).collect()
        ordered = sorted(rows, key=lambda r: (r.curve, r.doc_id is not None, r.doc_id or 0, r.text_crc32))
        n, first = len(ordered), {}
        for p, r in enumerate(ordered):
            first.setdefault(p * k // n, p)
        assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in rows) == Counter((r.doc_id, r.text_crc32, p * k // n, p - first[p * k // n]) for p, r in enumerate(ordered))


def test_files_are_pruned(small):
    """A search by language and length, or by a range of ids, opens fewer shards (by their least and largest values) than documents dealt by id need for both."""
    rows = hilbert.document_shards(small, 20).join(small.select("doc_id", "lang", "n_chars"), "doc_id").collect()

    def opened(key):
        boxes = {}
        for r in rows:
            boxes.setdefault(key(r), []).append(r)
        ranges = [[(min(f(r) for r in b), max(f(r) for r in b)) for f in (lambda r: r.lang, lambda r: r.n_chars)] for b in boxes.values()]
        return sum(all(lo <= v <= hi for v, (lo, hi) in zip((q.lang, q.n_chars), b, strict=True)) for q in rows for b in ranges)

    assert opened(lambda r: r.shard) < 0.5 * opened(lambda r: r.doc_id % 20)
