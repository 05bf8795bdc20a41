"""Scalar text functions as Column expressions: keys, titles, headings, tokens, cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of the retrieval tokenizer.
SEPARATORS = " -_/，。（）()、：:"
#: Characters that matching ignores.
IGNORED = " \t\r\n　.,;:!?'\"()[]{}<>|/-_，。；：！？、（）【】《》“”‘’·…—"
#: Marks of unfinished text.
PLACEHOLDERS = ("todo", "tbd", "xxx", "lorem", "[insert", "to be filled", "placeholder", "待补充", "此处填写")


def compact(text: Column) -> Column:
    """Without any white space, Unicode's included."""
    return F.regexp_replace(text, r"[\s\p{Z}]+", "")


def match_key(text: Column) -> Column:
    """Lower case, without white space and punctuation."""
    return F.translate(F.lower(text), IGNORED, "")


def outline_key(text: Column) -> Column:
    """A heading's key: required and optional marks, white space and edge punctuation dropped."""
    bare = reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit("")), ("[required]", "[optional]", "必填", "选填"), F.lower(text))
    return F.regexp_replace(compact(bare), r"^[.,;:、，。；：()（）-]+|[.,;:、，。；：()（）-]+$", "")


def clean_title(text: Column) -> Column:
    """Without numbering, bullets, dot leaders with page numbers, and edge punctuation."""
    bare = F.regexp_replace(F.trim(text), r"^(?:[0-9]+(?:[.][0-9]+)*[.)、]?|[(][0-9a-z]{1,3}[)]|[-*•])[ ]*", "")
    bare = F.regexp_replace(bare, r"[ .…]{2,}[0-9]+$", "")
    return F.regexp_replace(F.trim(bare), r"^[.,;:]+|[.,;:]+$", "")


def heading_level(text: Column) -> Column:
    """Level of a heading line, 0 for body: `Chapter n` 1; n 2; n.n and deeper min(depth, 4); (n) 3; long or sentence-like lines 0."""
    depth = F.size(F.split(F.regexp_extract(text, r"^([0-9]+(?:[.][0-9]+)*)[.)]?[ ]", 1), "[.]"))
    numbered = F.regexp_extract(text, r"^([0-9]+(?:[.][0-9]+)*)[.)]?[ ]", 1) != ""
    sentence = F.length(text).between(31, 80) & text.rlike("[.;!?。；！？]$")
    return (
        F.when(text.isNull() | (F.length(text) > 80) | sentence, 0).when(text.rlike("^(?:Chapter|CHAPTER) [0-9]+|^第[0-9一二三四五六七八九十]+章"), 1).when(text.rlike("^[一二三四五六七八九十]+、"), 2)
        .when(numbered, F.when(depth == 1, 2).otherwise(F.least(depth, F.lit(4)))).when(text.rlike("^[(（][0-9一二三四五六七八九十]+[)）]"), 3).otherwise(0)
    )


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SEPARATORS, " " * len(SEPARATORS)), r"\s+"), lambda w: w != "")


def grams(text: Column) -> Column:
    """Distinct retrieval tokens: all parts of 2 to 4 characters of each word, and the words."""
    parts = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(F.filter(F.sequence(F.lit(2), F.lit(4)), lambda n: i + n - 1 <= F.length(w)), lambda n: F.substr(w, i, n))))
    return F.array_distinct(F.concat(F.flatten(F.transform(words(text), parts)), words(text)))


def han_grams(text: Column) -> Column:
    """Distinct runs of Han characters, each before its parts of 2 to 4."""
    runs = F.regexp_extract_all(text, F.lit("[一-鿿]+"), F.lit(0))
    spans = lambda w, k: F.when(F.length(w) >= k, F.transform(F.sequence(F.lit(1), F.length(w) - k + 1), lambda i: F.substr(w, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(runs, lambda w: F.concat(F.array(w), spans(w, 2), spans(w, 3), spans(w, 4)))))


def parts_of(text: Column, n: int) -> Column:
    """All parts of n characters, in order: one pass over the text, whatever its length."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def held_in(short: DataFrame, held: str, long: DataFrame, holder: str, n: int = 8) -> DataFrame:
    """Pairs of rows whose column held may lie in holder: an equi-join of held's beginning (8 characters; n of shorter ones) with all parts of holder of that length.

    No pair is lost where held has n characters or more; the caller tests the whole texts. The texts of a side are never compared with all of
    the other. Parts travel with a hash of their holder only, and a holder's row is joined back once for each row that met one of its parts.
    """
    name = F.xxhash64(holder).alias("q_holder")

    def met(some: DataFrame, k: int) -> DataFrame:
        named = F.arrays_zip(F.array_repeat(F.xxhash64(holder), F.length(holder)).alias("q_holder"), F.array_distinct(parts_of(F.col(holder), k)).alias("q_part"))  # hashed once, not for each part
        parts = long.select(F.explode(named).alias("q")).select("q.*").where("q_part IS NOT NULL")
        pairs = parts.join(some.withColumn("q_part", F.left(held, F.lit(k))), "q_part").drop("q_part").distinct()
        return pairs.join(long.withColumn("q_holder", name), "q_holder").drop("q_holder")

    size = F.length(held)
    if n >= 8:
        return met(short.where(size >= n), n)
    return met(short.where(size >= 8), 8).unionByName(met(short.where((size >= n) & (size < 8)), n))


def bucket(token: Column, dims: int = 128) -> Column:
    """A token's place in a hashed vector: the last byte of its MD5, modulo dims."""
    return (F.conv(F.right(F.md5(token), F.lit(2)), 16, 10).cast("int") % dims).cast("int")


def head_tail(text: Column, most: int, head: float = 0.7, marker: str = " ... ") -> Column:
    """Texts over `most` characters keep that share in front and the rest behind, with a marker between."""
    first = int(most * head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(first)), F.lit(marker), F.right(text, F.lit(most - first))))


def keyword_cut(text: Column, most: int, keywords: tuple[str, ...], head: float = 0.45, tail: float = 0.15) -> Column:
    """Texts over `most` characters keep that share in front and behind, and between them the different lines of the rest that name a keyword, in order, as long as each still fits."""
    first, last = int(most * head), int(most * tail)
    middle = F.split(F.substr(text, F.lit(first + 1), F.length(text) - first - last), "\n")
    named = F.array_distinct(F.filter(middle, lambda x: reduce(lambda a, b: a | b, [x.contains(k) for k in keywords])))
    kept = F.aggregate(named, F.lit(""), lambda acc, x: F.when(F.length(acc) + F.length(x) + 1 <= most - first - last, F.concat(acc, F.lit("\n"), x)).otherwise(acc))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(first)), kept, F.lit("\n"), F.right(text, F.lit(last))))


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://[^ \n\t]+", "")


def is_placeholder(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True)) | reduce(lambda a, b: a | b, [F.lower(text).contains(p) for p in PLACEHOLDERS])


def collapse_doubled(text: Column) -> Column:
    """AABBCC becomes ABC where every character is doubled and there are six or more."""
    return F.when((F.length(text) >= 6) & text.rlike(r"^(?:(.)\1)+$"), F.regexp_replace(text, r"(.)\1", "$1")).otherwise(text)


def slug(text: Column, most: int = 64) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def reference_number(text: Column) -> Column:
    """The number of an attachment, annex or appendix named in a text; null without one."""
    return F.nullif(F.regexp_extract(text, "(?:Attachment|Annex|Appendix|附件|附表|附录) *([0-9]{1,3})", 1), F.lit("")).cast("int")
