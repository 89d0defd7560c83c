"""Dates. Release dates are dirty text and a month 14 is legal, so they stay digits and
are never cast to a calendar date inside a lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import empty_to_null

# Fixed value: the first M-D-YYYY or M/D/YYYY in a question.
QUESTION_DATE = r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})"


def question_date(question: Column, day_first: bool = False) -> Column:
    """YYYYMMDD digits of the first date in the text, or null. No calendar check."""
    found = empty_to_null(F.regexp_extract(question, QUESTION_DATE, 0))
    parts = F.split(found, "[-/]")
    first, second = (F.lpad(F.get(parts, i), 2, "0") for i in (0, 1))
    month, day = (second, first) if day_first else (first, second)
    return F.concat(F.get(parts, 2), month, day)


def date_digits(value: Column) -> Column:
    """The first eight digits of a date text; null becomes empty."""
    return F.substring(F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", ""), 1, 8)


def unbracketed(value: Column) -> Column:
    """A date text without what it has in brackets."""
    return F.regexp_replace(value, r"\[[^\]]*\]", "")


def day_number(digits: Column) -> Column:
    """Days since 1970 of eight digits that are a calendar date; null for others."""
    whole = F.when(F.length(digits) == 8, digits)
    return F.unix_date(F.try_to_timestamp(whole, F.lit("yyyyMMdd")).cast("date"))


def undashed(value: Column) -> Column:
    return F.replace(F.coalesce(value, F.lit("")), F.lit("-"), F.lit(""))


def day_key(ts: Column) -> Column:
    """yyyy-MM-dd in the session time zone."""
    return F.date_format(ts, "yyyy-MM-dd")
