"""Exact nearest-rank percentiles from a histogram.

Values are counted map-side, so what is shuffled is one row per distinct value. The rank is
found in two steps: a window over coarse buckets picks the bucket, a window inside it picks
the value. No window holds more than the buckets of a group or the values of a bucket, and
no task holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 65_536


def exact_percentiles(
    df: DataFrame, value: str, percents: dict[str, int], groups: tuple[str, ...] = (),
    weight: str | None = None,
) -> DataFrame:
    """One row per group with a column per entry of ``percents`` (name to percent). Nulls
    are left out; a group without values gives no row. ``weight`` counts pre-counted rows."""
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    by = [F.col(g) for g in groups]
    values = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(count.alias("_n"))
        .withColumn("_bucket", F.floor(F.col("_v") / BUCKET))
    )
    per_bucket = values.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_in_bucket"))
    whole = Window.partitionBy(*by)
    running = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_bucket = per_bucket.select(
        *by,
        "_bucket",
        (F.sum("_in_bucket").over(running) - F.col("_in_bucket")).alias("_before"),
        F.col("_in_bucket"),
        F.sum("_in_bucket").over(whole).alias("_total"),
    )
    # Nearest rank, computed in doubles.
    ranks = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.greatest(F.ceil(F.lit(p / 100.0) * F.col("_total")), F.lit(1)).alias("rank"),
            )
            for name, p in percents.items()
        ]
    )
    wanted = (
        per_bucket.withColumn("_r", F.explode(ranks))
        .where(
            (F.col("_before") < F.col("_r.rank"))
            & (F.col("_r.rank") <= F.col("_before") + F.col("_in_bucket"))
        )
        .select(
            *by, "_bucket", F.col("_r.name").alias("_name"),
            (F.col("_r.rank") - F.col("_before")).alias("_rank"),
        )
    )
    within = (
        Window.partitionBy(*by, "_bucket")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reached = values.withColumn("_upto", F.sum("_n").over(within))
    picked = reached.join(wanted, [*groups, "_bucket"]).where(
        (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))
    )
    return picked.groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in percents]
    )


def approximate_percentiles(
    df: DataFrame, value: str, percents: dict[str, int], groups: tuple[str, ...] = ()
) -> DataFrame:
    """The same columns from Spark's quantile sketch: one pass, bounded state, near ranks."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups)
        .agg(*[F.percentile_approx(value, p / 100.0).alias(n) for n, p in percents.items()])
    )
