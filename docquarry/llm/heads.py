"""Counts of a corpus's distinct parts (words, pre-tokens): tallied before they are shuffled, and the most frequent ones as a bounded table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct parts that a task counts before it passes them on.
FLUSH = 200_000


def tallied(texts: DataFrame, split: Callable[[], Callable[[str | None], list]], kind: str) -> DataFrame:
    """part (of the SQL type `kind`), n over the first column's texts; split() is called in the task and gives a text's parts."""

    def rows(bag: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(bag.keys()), pa.binary() if kind == "binary" else pa.string()), pa.array(list(bag.values()), pa.int64())], ["part", "n"])

    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bag = split(), Counter()
        for b in it:
            for t in b.column(0).to_pylist():
                bag.update(parts(t))
                if len(bag) > FLUSH:
                    yield rows(bag)
                    bag = Counter()
        if bag:
            yield rows(bag)

    return texts.mapInArrow(count, f"part {kind}, n long").groupBy("part").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int, value: str = "n") -> dict:
    """value by part for the parts above a count n that at most `most` parts reach, by a histogram of counts on a log scale."""
    level = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for k, n in histogram:
        total += n
        if total > most:
            break
        least = k
    if least is None:
        return {}
    got = counts.where(level >= least).select("part", F.col(value).alias("q_value")).toArrow()
    return dict(zip(got.column("part").to_pylist(), got.column("q_value").to_pylist(), strict=True))
