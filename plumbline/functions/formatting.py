"""Answer texts built from a matched release."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import last_tag
from .text import clip, empty_to_null

# Answer wording.
DONT_KNOW = "I don't know about the question you asked."
NO_RELEASE = "No matching release found for that product or date."
NOT_AVAILABLE = "N/A"
NOTES_LENGTH = 200
PREVIEW_LENGTH = 80


def _or_na(col: Column) -> Column:
    return F.coalesce(empty_to_null(col), F.lit(NOT_AVAILABLE))


def vendor_patch_version(number: Column, tags: Column) -> Column:
    """For "patch for X": the version number, else the last tag."""
    return F.coalesce(number, last_tag(tags), F.lit(NOT_AVAILABLE))


def feed_patch_version(number: Column, tags: Column) -> Column:
    """For a patch found by text: the last tag, else the version number."""
    return F.coalesce(last_tag(tags), number, F.lit(""))


def patch_answer(version: Column, url: Column, notes: Column) -> Column:
    link = F.when(
        F.coalesce(url, F.lit("")) != "", F.concat(F.lit("URL: "), url, F.lit("\n"))
    ).otherwise("")
    return F.concat(
        F.lit("Patch version: "),
        version,
        F.lit("\n"),
        link,
        F.lit("Release notes: "),
        clip(_or_na(notes), NOTES_LENGTH),
    )


def os_version(number: Column) -> Column:
    return F.coalesce(number, F.lit(""))


def last_segment(version: Column) -> Column:
    """The part after the last dot; the whole text without a dot."""
    return F.try_element_at(F.split(version, r"\."), F.lit(-1))


def os_answer(version: Column, notes: Column, license_: Column) -> Column:
    return F.concat(
        F.lit("Version: "),
        version,
        F.lit(". Release notes: "),
        _or_na(notes),
        F.lit(". License: "),
        _or_na(license_),
        F.lit("."),
    )


def preview(answer: Column) -> Column:
    return clip(answer, PREVIEW_LENGTH)
