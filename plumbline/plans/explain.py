"""How a question would be read: parse, branch label and, on request, the match.

The branch rules differ from those of the answer plan on purpose: this is the trace view,
which knows no vendor list and picks the product by keyword.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tags import mentions_vendor
from ..functions.text import empty_to_null
from ..operators.index import build, corpus_size, date_entries, first_position, product_entries
from ..operators.lookups import attach_releases, keep_asked, pick_dated, pick_product
from ..operators.questions import folded_texts, parse, with_texts
from ..operators.releases import vendor_feed
from ..operators.staging import join_side, stage
from ..schemas import release_column

# Branch labels, product keywords in order of preference.
NOT_LINUX, LINUX_PATCH, OS = "patch_non_linux → idk", "patch_linux", "os"
PRODUCTS = ("android", "ios", "windows")
LINUX, DEFAULT_PRODUCT = "linux", "android"
FIRST = "first item of the feed"  # no branch of a question


def explain_questions(questions: DataFrame) -> DataFrame:
    """Question rows with their parse and branch label; no lookup, no shuffle."""
    return _explained(with_texts(questions)).drop("text_key")


def _explained(rows: DataFrame) -> DataFrame:
    rows = parse(rows)
    text, vendor = F.col("normalized"), F.col("parsed_vendor")
    linux = F.contains(text, F.lit(LINUX)) & ~F.contains(text, F.lit("android"))
    branch = (
        F.when(vendor.isNotNull() & (vendor != LINUX), NOT_LINUX)
        .when(vendor.isNotNull() | linux, LINUX_PATCH)
        .otherwise(OS)
    )
    product = F.coalesce(
        *[F.when(F.contains(text, F.lit(p)), p) for p in PRODUCTS], F.lit(DEFAULT_PRODUCT)
    )
    return rows.withColumn("branch", branch).select(
        *[c for c in ("question_id", "text_key") if c in rows.columns],
        empty_to_null(F.col("text")).alias("raw_question"),
        empty_to_null(F.col("normalized")).alias("normalized_question"),
        "parsed_vendor",
        "parsed_date",
        "branch",
        F.when(F.col("branch") == OS, product).alias("product"),
    )


def explain_matches(questions: DataFrame, releases: DataFrame) -> DataFrame:
    """:func:`explain_questions` plus the size of the searched feed and the matched release.
    Texts are explained once and staged, and so is the match of each request. The releases are
    read three times: for the index of each branch, and for the columns of what was chosen."""
    linux, os = F.col("branch") == LINUX_PATCH, F.col("branch") == OS
    texts = stage(
        _explained(folded_texts(questions)).withColumns(
            {
                "key": F.when(linux, LINUX).otherwise(F.col("product")),
                "date": F.coalesce("parsed_date", F.lit("")),
            }
        ),
        "explained",
    )
    requests = texts.where(linux | os).select("branch", "key", "date").distinct()
    feed = vendor_feed(releases, LINUX)

    def of(branch):
        return requests.where(branch).select("key", "date")

    feed_index = build(date_entries(feed))
    product_index = build(keep_asked(product_entries(releases), of(os)))
    first = releases.sparkSession.range(1).select(
        F.lit(FIRST).alias("branch"),
        F.lit("").alias("key"),
        F.lit("").alias("date"),
        first_position(feed_index).alias("pos"),
    )
    found = (
        pick_dated(of(linux), feed_index)
        .withColumn("branch", F.lit(LINUX_PATCH))
        .unionByName(pick_product(of(os), product_index).withColumn("branch", F.lit(OS)))
        .unionByName(first)
    )
    docs = releases.select(
        "pos", "name", release_column(releases, "brand"), "release_date", "tags"
    )
    has_vendor = mentions_vendor(F.col("key"), F.col("tags"), F.col("name"), F.col("brand"))
    matched = attach_releases(found, docs).select(
        "branch",
        "key",
        "date",
        F.when(linux & F.col("pos").isNotNull(), has_vendor).alias("matched_has_vendor"),
        F.col("name").alias("matched_name"),
        F.col("release_date").alias("matched_release_date"),
        F.col("tags").alias("matched_tags"),
    )
    matched = stage(matched, "matched")
    first = matched.where(F.col("branch") == FIRST)
    return (
        with_texts(questions)
        .select("question_id", "text_key")
        .join(join_side(texts), "text_key", "left")
        .join(join_side(matched), ["branch", "key", "date"], "left")
        .withColumns(
            {
                "items_count": F.when(linux, F.coalesce(corpus_size(feed_index), F.lit(0))).when(
                    os, F.coalesce(corpus_size(product_index), F.lit(0))
                ),
                "first_item_tags": F.when(linux, first.select("matched_tags").scalar()),
                "first_item_name": F.when(linux, first.select("matched_name").scalar()),
            }
        )
        .drop("text_key", "key", "date")
    )
