"""Titles that resemble each other: matching blocks, pairs of characters and words, scored exactly only where a bound allows it."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.runtime import materialised, ship

#: Shares of the score, what words inside other words count for, and the shortest such word.
SHARES = {"blocks": 0.45, "pairs": 0.35, "words": 0.20}
INSIDE, LEAST_INSIDE = 0.75, 3
#: Below it, titles without a common pair of characters could match: 0.45 and 0.20 without a share of pairs.
LEAST = 0.66


def bare(title: Column) -> Column:
    """A title as its similarity sees it: lower case, without numbering, quotes, brackets and white space."""
    return F.regexp_replace(F.lower(T.clean_title(title)), r"[《》〈〉“”\"'（）()\s]", "")


def title_words(title: Column) -> Column:
    """Its distinct words of two characters and more, without digits, quotes and edge punctuation; what stands in brackets is no word."""
    text = F.regexp_replace(F.regexp_replace(F.lower(T.clean_title(title)), "[（(].*?[）)]", ""), "[《》〈〉“”\"'0-9]", "")
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[、，,；;/\s]+"), lambda w: F.btrim(w, F.lit("：:.-—_ "))), lambda w: F.length(w) >= 2))


def word_score(a: Column, b: Column) -> Column:
    """Jaccard of two sets of words; INSIDE at least where a word holds one of the other set."""
    inside = F.exists(a, lambda x: F.exists(b, lambda y: (F.least(F.length(x), F.length(y)) >= LEAST_INSIDE) & (x.contains(y) | y.contains(x))))
    both = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return F.when(inside, F.greatest(both, F.lit(INSIDE))).otherwise(both)


def pairs_of(text: Column) -> Column:
    """Its pairs of neighbouring characters, repeats kept; a text of at most two characters whole."""
    return F.when(F.length(text) <= 2, F.array(text)).otherwise(T.parts_of(text, 2))


def norm(parts: Column) -> Column:
    """The length of the vector of how often each part occurs: a part's k-th occurrence adds 2k - 1 to its square, which sum to the squared count."""
    step = lambda z, x: F.struct(x.alias("x"), F.when(x == z["x"], z["k"] + 1).otherwise(F.lit(1)).alias("k"), (z["s"] + 2 * F.when(x == z["x"], z["k"] + 1).otherwise(F.lit(1)) - 1).cast("long").alias("s"))
    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("s"))
    return F.sqrt(F.aggregate(F.sort_array(parts), start, step, lambda z: z["s"]))


def matched_udf(spark):
    """Share of two texts' characters in matching blocks, on Arrow batches: no built-in has it."""
    ship(spark)

    @F.pandas_udf("double")
    def matched(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return matched


def candidates(left: DataFrame, right: DataFrame, by: str, least: float) -> DataFrame:
    """by, a, b (titles), a_bare, b_bare, pairs, words: all pairs of titles with equal `by` that can reach `least`, each pair of different titles once.

    Such titles share a pair of characters. The bound takes for the matching blocks what two lengths allow at most. Each side's titles are stored
    with a number, their words and norms, made once a title; what meets by pairs of characters are numbers only.
    """
    if least < LEAST:
        raise ValueError(f"titles without a common pair of characters could reach {least}; {LEAST} is the least")

    def listed(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(by, F.col("title").alias(name)).where("length(trim(title)) > 0").distinct().withColumn(f"{name}_bare", bare(F.col(name))).where(f"{name}_bare <> ''")
        told = rows.withColumns({f"{name}_norm": norm(pairs_of(F.col(f"{name}_bare"))), f"{name}_words": title_words(F.col(name)), f"{name}_id": F.monotonically_increasing_id()})
        return materialised(told)

    def counted(rows: DataFrame, name: str) -> DataFrame:
        parts = rows.select(by, f"{name}_id", F.explode(pairs_of(F.col(f"{name}_bare"))).alias("part"))
        return parts.repartition(by, "part").groupBy(by, f"{name}_id", "part").agg(F.count(F.lit(1)).alias(f"{name}_n"))  # dealt as the join wants them

    a, b = listed(left, "a"), listed(right, "b")
    met = counted(a, "a").join(counted(b, "b"), [by, "part"]).groupBy("a_id", "b_id").agg(F.sum(F.col("a_n") * F.col("b_n")).alias("dot"))
    met = met.join(a, "a_id").join(b.drop(by), "b_id").withColumn("pairs", F.col("dot") / F.col("a_norm") / F.col("b_norm"))
    met = met.withColumn("words", word_score(F.col("a_words"), F.col("b_words")))
    la, lb = F.length("a_bare"), F.length("b_bare")
    bound = SHARES["blocks"] * 2 * F.least(la, lb) / (la + lb) + SHARES["pairs"] * F.col("pairs") + SHARES["words"] * F.col("words")
    return met.where(F.greatest(bound, F.col("words")) >= least - 1e-9).select(by, "a", "b", "a_bare", "b_bare", "pairs", "words")


def similar_titles(left: DataFrame, right: DataFrame, by: str, least: float = LEAST) -> DataFrame:
    """by, a, b, score: pairs of titles (column title of both tables) with equal `by` and a score of `least` or more; blank and null titles resemble none."""
    matched = matched_udf(left.sparkSession)
    met = candidates(left, right, by, least)
    score = SHARES["blocks"] * matched(F.col("a_bare"), F.col("b_bare")) + SHARES["pairs"] * F.col("pairs") + SHARES["words"] * F.col("words")
    return met.withColumn("score", F.round(F.greatest(score, F.col("words")), 6)).where(F.col("score") >= least).select(by, "a", "b", "score")
