"""Question intake, parsing and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import question_date
from ..functions.text import (
    asks_for_release,
    one_repeated_character,
    patch_vendor,
    strip,
    text_key,
)
from .vendors import resolve_vendor, vendors_in_names

# Branches and the flow each is logged under.
PATCH_FOR, LINUX_TEXT, OS_VERSION, UNKNOWN = "patch_for", "linux_text", "os", "unknown"


def question_text(questions: DataFrame) -> Column:
    """The first of ``question``, ``prompt`` and ``q`` that is not null, trimmed. An empty
    ``question`` therefore wins over a filled ``prompt``."""
    fields = [F.col(c) for c in ("question", "prompt", "q") if c in questions.columns]
    return strip(F.coalesce(*fields, F.lit("")))


def parse(df: DataFrame, text: str = "text", day_first: bool = False) -> DataFrame:
    """Add ``normalized``, ``parsed_vendor`` and ``parsed_date`` to rows holding a text."""
    normalized = F.lower(F.col(text))
    return df.withColumns(
        {
            "normalized": normalized,
            "parsed_vendor": patch_vendor(normalized),
            "parsed_date": question_date(normalized, day_first),
        }
    )


def add_vendors(df: DataFrame, vendor_names: DataFrame, boundary: bool = False) -> DataFrame:
    """Add ``vendor_name``, ``vendor_in_names`` and ``is_vendor_found`` to parsed texts.

    ``df`` holds each text once, so nothing here is skewed by repeated questions.
    """
    named = resolve_vendor(df, vendor_names, boundary, text="normalized")
    listed = vendors_in_names(df, "parsed_vendor", vendor_names).withColumn(
        "vendor_in_names", F.lit(True)
    )
    return (
        df.join(named, "text_key", "left")
        .join(listed, "parsed_vendor", "left")
        .withColumn("vendor_in_names", F.coalesce("vendor_in_names", F.lit(False)))
        .withColumn(
            "is_vendor_found",
            (F.col("vendor_name").isNotNull() | F.col("vendor_in_names")).cast("int"),
        )
    )


def route(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``branch`` and ``flow``. The first rule that holds decides.

    ``strict`` also sends a text of one repeated character to ``unknown``.
    """
    question = F.col("normalized")
    linux = F.contains(question, F.lit("linux")) & ~F.contains(question, F.lit("android"))
    wanted = asks_for_release(question, F.col("vendor_name"), F.col("parsed_date"))
    if strict:
        wanted = wanted & ~one_repeated_character(question)
    branch = (
        F.when(F.col("parsed_vendor").isNotNull(), PATCH_FOR)
        .when(linux, LINUX_TEXT)
        .when(wanted, OS_VERSION)
        .otherwise(UNKNOWN)
    )
    flow = F.when(F.col("branch").isin(PATCH_FOR, LINUX_TEXT), "patch").otherwise(F.col("branch"))
    return df.withColumn("branch", branch).withColumn("flow", flow)


def with_texts(questions: DataFrame, *keep: str) -> DataFrame:
    """``(question_id, text, text_key, *keep)`` of every question."""
    return questions.select("question_id", question_text(questions).alias("text"), *keep).withColumn(
        "text_key", text_key(F.col("text"))
    )


def distinct_texts(questions: DataFrame) -> DataFrame:
    """``(text_key, text)``, each text once. Copies are folded before the shuffle. Grouped by
    the key alone, so that a filter on texts stays above it and branches of a plan share it."""
    return with_texts(questions).groupBy("text_key").agg(F.first("text").alias("text"))


def folded_texts(questions: DataFrame) -> DataFrame:
    """The same for a frame that is staged at once: folded by hashing, without a sort."""
    return with_texts(questions).select("text_key", "text").distinct()
