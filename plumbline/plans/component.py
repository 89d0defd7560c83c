"""The component view: the newest release of one product, shaped for display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import last_segment, os_version
from ..operators.lookups import attach_releases, product_release

SUPPORTED = "os"


def format_os(releases: DataFrame) -> DataFrame:
    """Display columns of operating-system releases."""
    return releases.select(
        "pos",
        os_version(F.col("version_number")).alias("main"),
        last_segment(os_version(F.col("version_number"))).alias("last_value"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("license", F.lit("")).alias("license"),
        F.col("name").alias("product_name"),
        "release_date",
        "tags",
    )


def component_snapshot(
    releases: DataFrame, component: str = SUPPORTED, product: str = "android"
) -> DataFrame:
    """One row: the newest release of ``product`` (the first of the corpus when unknown) and
    the number of releases. Any other component than ``os`` gives an error row."""
    spark = releases.sparkSession
    if component.lower() != SUPPORTED:
        return spark.range(1).select(F.lit("Only q=os is supported").alias("error"))
    request = spark.range(1).select(F.lit(product).alias("key"), F.lit("").alias("date"))
    best = attach_releases(product_release(request, releases), releases)
    count = releases.agg(F.count(F.lit(1))).scalar()
    return format_os(best).withColumn("components_count", count)
