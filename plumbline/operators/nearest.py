"""Nearest point per key, without pairing every probe with every point.

Dates are whole numbers YYYYMMDD and the distance is their difference, not days. Points and
probes of a key are cut into years. Within a year a window finds the closest point on each
side; a second window over the years finds the last point of the nearest earlier year and
the first point of the nearest later one. The closest of these four is the answer. A window
holds at most the distinct dates of one year, or the years of one key, so a hot key never
lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

YEAR = 10_000


def nearest_points(probes: DataFrame, points: DataFrame) -> DataFrame:
    """``probes(key, at)`` and ``points(key, at, best)``, each pair of key and number once.

    Returns ``(key, at, best)`` with the closest point's ``best``; of two equally close
    points, the one with the smaller ``best``.
    """
    point = F.struct(F.col("at"), F.col("best"))
    none = F.lit(None).cast(T.StructType([points.schema["at"], points.schema["best"]]))
    rows = points.select(
        "key", "at", point.alias("point"), F.lit(False).alias("asked")
    ).unionByName(probes.select("key", "at", none.alias("point"), F.lit(True).alias("asked")))
    rows = rows.withColumn("year", F.floor(F.col("at") / YEAR))

    earlier = Window.partitionBy("key", "year").orderBy("at", "asked")
    later = Window.partitionBy("key", "year").orderBy(F.desc("at"), "asked")
    beside = rows.select(
        "key",
        "year",
        "at",
        "asked",
        F.last("point", ignorenulls=True).over(earlier).alias("below"),
        F.last("point", ignorenulls=True).over(later).alias("above"),
    ).where("asked")

    years = rows.groupBy("key", "year").agg(
        F.min_by("point", F.when(F.col("point").isNotNull(), F.col("at"))).alias("lowest"),
        F.max_by("point", F.when(F.col("point").isNotNull(), F.col("at"))).alias("highest"),
    )
    so_far = (Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("year").rowsBetween(*so_far)
    after = Window.partitionBy("key").orderBy(F.desc("year")).rowsBetween(*so_far)
    around = years.select(
        "key",
        "year",
        F.last("highest", ignorenulls=True).over(before).alias("year_below"),
        F.last("lowest", ignorenulls=True).over(after).alias("year_above"),
    )

    near = F.filter(F.array("below", "above", "year_below", "year_above"), lambda p: p.isNotNull())
    ranked = F.transform(
        near, lambda p: F.struct(F.abs(p["at"] - F.col("at")).alias("gap"), p["best"].alias("best"))
    )
    return (
        beside.join(around, ["key", "year"])
        .select("key", "at", F.array_min(ranked)["best"].alias("best"))
        .where(F.col("best").isNotNull())
    )
