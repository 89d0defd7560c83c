"""Vendor names: the longest name in a question, and two-way containment in the list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, strip, text_key
from .containment import find_in_texts

WORD_EDGE = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
EDGE_MARK = "\x01"


def name_dictionary(vendor_names: DataFrame) -> DataFrame:
    """One row per folded name; the first position in the list decides its spelling. A
    dictionary is returned as it is."""
    if "folded" in vendor_names.columns:
        return vendor_names
    return (
        vendor_names.select(
            fold("name").alias("folded"), strip("name").alias("name"), F.col("pos").alias("pos")
        )
        .where(F.col("folded") != "")
        .groupBy("folded")
        .agg(F.min(F.struct("pos", "name")).alias("first"))
        .select("folded", "first.pos", "first.name")
    )


def resolve_vendor(
    texts: DataFrame,
    vendor_names: DataFrame,
    boundary: bool = False,
    key: str = "text_key",
    text: str = "text",
) -> DataFrame:
    """The longest listed name inside each text; equal lengths go to the earlier name.

    ``texts`` holds each ``key`` once. Returns ``(key, vendor_name)`` for texts with a
    match. Names of one letter are ignored. ``boundary`` asks for whole words.
    """
    names = name_dictionary(vendor_names).where(F.length("folded") >= 2)
    body = F.lower(F.col(text))
    if boundary:
        hits = _whole_words(texts.select(key, body.alias("_body")), names)
    else:
        hits = find_in_texts(texts.select(key, body.alias("_body")), "_body", names, "folded", 2)
    longest = F.min(F.struct(-F.length("folded"), "pos", "name")).alias("longest")
    return hits.groupBy(key).agg(longest).select(key, F.col("longest.name").alias("vendor_name"))


def _whole_words(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Occurrences between word edges: the edges are marked in texts and names alike, so that
    a name's marks must meet the text's."""
    def marked(col):
        return F.regexp_replace(col, WORD_EDGE, EDGE_MARK)

    bodies = texts.withColumn("_body", marked("_body"))
    return find_in_texts(bodies, "_body", names.withColumn("marked", marked("folded")), "marked", 2)


def vendors_in_names(vendors: DataFrame, vendor: str, vendor_names: DataFrame) -> DataFrame:
    """The vendors that contain a listed name or lie inside one, each once."""
    asked = vendors.select(fold(vendor).alias(vendor)).where(F.col(vendor) != "").distinct()
    asked = asked.withColumn("_vendor_key", text_key(F.col(vendor)))
    names = name_dictionary(vendor_names).select("folded")
    holding = find_in_texts(asked, vendor, names, "folded").select("_vendor_key")
    listed = names.select(text_key(F.col("folded")).alias("_name_key"), "folded")
    held = find_in_texts(listed, "folded", asked, vendor).select("_vendor_key")
    found = holding.unionByName(held).distinct()
    return asked.join(found, "_vendor_key", "left_semi").select(vendor)
