"""What a reader sees of an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANK, empty_to_null, strip

# Line labels hidden when the field they repeat is shown on its own.
VERSION_LINE = rf"(?i)\A(patch{BLANK}*)?version{BLANK}*:"
URL_LINE = rf"(?i)\Aurl{BLANK}*:"
NOTES_LINE = rf"(?i)\Arelease{BLANK}*notes?{BLANK}*:"


def _filled(name):
    return F.coalesce(F.col(name), F.lit("")) != ""


def display_answers(answers: DataFrame) -> DataFrame:
    """Add ``clean_answer`` (without lines that repeat a shown field), ``shown_answer`` (the
    version where there is one) and ``notes_is_link``."""
    has_version, has_url, has_notes = _filled("version"), _filled("url"), _filled("notes")
    lines = F.transform(F.split("answer", "\n"), strip)
    kept = F.filter(
        lines,
        lambda line: (line != "")
        & ~(has_version & line.rlike(VERSION_LINE))
        & ~(has_url & line.rlike(URL_LINE))
        & ~(has_notes & line.rlike(NOTES_LINE)),
    )
    clean = F.coalesce(F.array_join(kept, "\n"), F.lit(""))
    return answers.withColumns(
        {
            "clean_answer": clean,
            "shown_answer": F.coalesce(empty_to_null(F.col("version")), clean),
            "notes_is_link": F.coalesce(F.startswith(F.col("notes"), F.lit("http")), F.lit(False)),
        }
    )
