"""Text columns: trimming, question parsing and the intent test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank when a question or name is trimmed.
BLANKS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# Question patterns. The vendor ends before " on ", a full stop,
# a question mark or the end of the text, and never spans a comma.
PATCH_VENDOR = rf"patch{BLANK}+for{BLANK}+([^,.?]+?)(?={BLANK}+on{BLANK}+|{BLANK}*[.?]|{BLANK}*\z)"
# Longer words that hold one of these are left out, since the shorter one matches wherever they do.
VERSION_WORDS = r"version|release|build|firmware|update|license|note"
OS_WORDS = (
    r"operating system|(?<![A-Za-z0-9_])os(?![A-Za-z0-9_])"
    r"|android|ios|windows|linux|ubuntu|macos"
)
SAME_CHARACTER = r"\A(.)\1*\z"


def strip(col: Column | str) -> Column:
    """Remove blanks of every Unicode kind from both ends (SQL ``trim`` removes spaces only)."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def fold(col: Column | str) -> Column:
    """The form in which names are compared: trimmed and lower-case, null as empty."""
    return F.lower(strip(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))))


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def patch_vendor(question: Column) -> Column:
    """X in "patch for X", or null, for a lower-case question. The plain test spares most
    questions the pattern."""
    named = empty_to_null(strip(F.regexp_extract(question, PATCH_VENDOR, 1)))
    return F.when(F.contains(question, F.lit("patch")), named)


def asks_for_release(question: Column, vendor: Column, date: Column) -> Column:
    """Does the text look like a version question? Words are matched anywhere, so
    "notebook" counts through "note"."""
    return (
        vendor.isNotNull()
        | date.isNotNull()
        | question.rlike(VERSION_WORDS)
        | question.rlike(OS_WORDS)
    )


def one_repeated_character(question: Column) -> Column:
    return question.rlike(SAME_CHARACTER)


def clip(text: Column, length: int) -> Column:
    """The first ``length`` characters, with an ellipsis when something was left out."""
    return F.concat(
        F.substring(text, 1, length),
        F.when(F.length(text) > length, F.lit("…")).otherwise(F.lit("")),
    )


SHORT_TEXT = 128


def text_key(text: Column) -> Column:
    """Key of a text in joins and groupings: the text, or a digest of a long one. A digest is
    longer than any text that is its own key, so no text has the key of another one's digest.
    Never null, and known to be: a null test pushed into one branch of a plan would keep the
    branches from sharing their shuffle."""
    digest = F.concat(F.lit("#"), F.coalesce(F.sha2(text, 512), F.lit("")))
    return F.when(F.length(text) <= SHORT_TEXT, text).otherwise(digest)
