"""The release table: search, and the narrow columns that lookups match on."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_digits
from ..functions.tags import first_tag, has_tag, lower_tags, mentions_vendor
from ..functions.text import empty_to_null, strip
from ..schemas import release_column

PATCH = "patch"


def order_by(age: Column, pos: Column) -> Column:
    """Two whole numbers as one that sorts by both, so that the smallest folds by hashing. The
    position is the lower part and not negative; what does not fit is an error."""
    high = age.cast("decimal(19,0)") * F.lit(Decimal(2**63)).cast("decimal(19,0)")
    return (high + pos.cast("decimal(19,0)")).cast("decimal(38,0)")


def position(order: Column) -> Column:
    """The position an order was made of."""
    return F.pmod(order, F.lit(Decimal(2**63))).cast("bigint")


def newest_first() -> Column:
    """Order of a release by age: newest first, then the earlier position. A missing
    timestamp counts as 0."""
    return order_by(-F.coalesce(F.col("ts_ms"), F.lit(0)), F.col("pos"))


def match_columns(releases: DataFrame, **flags: Column) -> DataFrame:
    """What the lookups read of a release, with conditions on it as further columns. Texts
    such as the notes stay in the scan."""
    return releases.select(
        *[flag.alias(name) for name, flag in flags.items()],
        "pos",
        newest_first().alias("newest"),
        date_digits(F.col("release_date")).alias("date_norm"),
        F.coalesce(F.col("release_date"), F.lit("")).alias("release_date"),
        F.lower(F.coalesce(F.col("name"), F.lit(""))).alias("name_lower"),
        F.lower(F.coalesce(release_column(releases, "brand"), F.lit(""))).alias("brand_lower"),
        F.col("tags"),
        lower_tags(F.col("tags")).alias("tags_lower"),
    )


def patch_feed(releases: DataFrame) -> DataFrame:
    return releases.where(F.col("channel") == PATCH)


def vendor_feed(releases: DataFrame, vendor: str = "linux") -> DataFrame:
    """Patch releases whose tags, name or brand contain the vendor."""
    return search_releases(releases, vendor, PATCH)


def search_releases(
    releases: DataFrame,
    vendor: str | None = None,
    channel: str | None = None,
    limit: int | None = None,
    page: int = 1,
) -> DataFrame:
    """Releases by channel and vendor text; with ``limit``, one page of them, newest first."""
    found = releases if channel is None else releases.where(F.col("channel") == channel)
    if vendor is not None:
        found = found.where(
            mentions_vendor(
                strip(F.lit(vendor)),
                F.col("tags"),
                F.col("name"),
                release_column(releases, "brand"),
            )
        )
    if limit is None:
        return found
    ordered = found.orderBy(F.coalesce(F.col("ts_ms"), F.lit(0)).desc(), F.col("pos"))
    return ordered.offset((page - 1) * limit).limit(limit)


def tagged_patches(matchable: DataFrame) -> DataFrame:
    """Releases that carry the patch tag, with their first tag as ``key``."""
    return matchable.where(has_tag(F.col("tags_lower"), PATCH)).withColumn(
        "key", first_tag(F.col("tags_lower"))
    )


def patch_and_cve_counts(releases: DataFrame) -> DataFrame:
    """``(vendor, n_releases, n_patches, n_cves)`` by product name; a blank one is ``unknown``."""
    vendor = F.coalesce(empty_to_null(strip(F.col("name"))), F.lit("unknown"))
    return releases.groupBy(vendor.alias("vendor")).agg(
        F.count(F.lit(1)).alias("n_releases"),
        F.count_if(F.col("channel") == PATCH).alias("n_patches"),
        F.count_if(F.coalesce("is_cve", F.lit(False))).alias("n_cves"),
    )


def cve_feed(releases: DataFrame) -> DataFrame:
    """Patches that mend a known vulnerability; the lookups take it as any other feed."""
    return patch_feed(releases).where("is_cve")
