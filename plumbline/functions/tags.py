"""Search-tag columns. A null array counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_tags(tags: Column) -> Column:
    return F.coalesce(F.transform(tags, lambda t: F.lower(t)), F.array().cast("array<string>"))


def has_tag(tags_lower: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags_lower, tag), F.lit(False))


def first_tag(tags_lower: Column) -> Column:
    return F.coalesce(F.try_element_at(tags_lower, F.lit(1)), F.lit(""))


def last_tag(tags: Column) -> Column:
    """Null for an empty or missing array."""
    return F.try_element_at(tags, F.lit(-1))


def mentions_vendor(vendor: Column, tags: Column, name: Column, brand: Column) -> Column:
    """A tag, the product name or the brand contains the vendor. A blank vendor never matches."""
    needle = F.lower(vendor)
    in_tags = F.coalesce(
        F.exists(lower_tags(tags), lambda t: F.coalesce(F.contains(t, needle), F.lit(False))),
        F.lit(False),
    )
    in_name = F.contains(F.lower(F.coalesce(name, F.lit(""))), needle)
    in_brand = F.contains(F.lower(F.coalesce(brand, F.lit(""))), needle)
    return F.coalesce((needle != "") & (in_tags | in_name | in_brand), F.lit(False))
