"""Dates, amounts and scores written in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = "(20[0-9]{2})[年/-]([0-9]{1,2})[月/-]([0-9]{1,2})"


def date_literals(text: Column) -> Column:
    """Valid dates of a text in order; impossible ones are skipped."""
    found = F.regexp_extract_all(text, F.lit(_DATE), F.lit(0))
    parts = F.transform(found, lambda d: F.split(F.regexp_replace(d, "[年月/-]", "-"), "-"))
    dates = F.transform(parts, lambda p: F.try_to_timestamp(F.concat_ws("-", F.get(p, F.lit(0)), F.lpad(F.get(p, F.lit(1)), 2, "0"), F.lpad(F.get(p, F.lit(2)), 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))
    return F.filter(dates, lambda d: d.isNotNull())


def first_date(text: Column) -> Column:
    return F.get(date_literals(text), F.lit(0))


def amount(text: Column) -> Column:
    """The first number with any sign, currency or unit around it."""
    return F.nullif(F.regexp_extract(text, "([0-9]+(?:[.][0-9]+)?)", 1), F.lit("")).cast("double")


def points(text: Column) -> Column:
    """The first `n points` of a scoring rule."""
    return F.nullif(F.regexp_extract(text, "([0-9]+(?:[.][0-9]+)?) *(?:points|分)", 1), F.lit("")).cast("double")
