"""The dashboard summary from stored days.

For each day three tables of cells are kept: counts by flow, status, vendor and reason; a histogram of
latencies by flow, status and vendor; and the newest events of each flow, status and vendor. Cells of
days add up, so a summary over any range, flow, status or vendor text is merged from them and equals
the one from the log. Today's refresh reads and replaces one day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import day_key
from ..operators.staging import stage
from ..operators.summary import (
    RECENT,
    SummaryFilter,
    count_columns,
    filter_events,
    reason_label,
    recent_events,
    vendor_label,
)
from .summary import FACETS, summary_of

CELLS, LATENCIES, NEWEST = "cells", "latencies", "newest"
_BY = ["day", "flow", "status", "vendor"]
#: Counts that add up, and the one of which the smallest remains.
_SUMS = [
    "total", "answered", "abstained", "errors", "vendor_not_found", "os_queries", "patch_queries", "latency_n", "latency_sum",
]
_EVENT = ["pos", "ts", "latency_ms", "reason", "is_vendor_found"]


def day_partials(events: DataFrame) -> dict[str, DataFrame]:
    """The cells of the days of some events, by table."""
    rows = events.withColumn("day", day_key(F.col("ts")))
    last = Window.partitionBy(*_BY).orderBy(F.desc("ts"), "pos")
    newest = rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= RECENT)
    return {
        CELLS: rows.groupBy(*_BY, reason_label().alias("reason")).agg(*count_columns()),
        LATENCIES: rows.where("latency_ms is not null").groupBy(*_BY, "latency_ms").agg(F.count(F.lit(1)).alias("total")),
        NEWEST: newest.select(*_BY, *_EVENT),
    }


def refresh_days(log: DataFrame, path: str, days: list[dt.date]) -> None:
    """Write the cells of some days anew; other days stay as they are. A day without events left
    holds nothing afterwards. Of a log by day, just the folders of these days are read."""
    if not days:
        return
    keys = [day.isoformat() for day in days]
    first, last = min(days), max(days)
    start, end = (F.lit(d.isoformat()).cast("timestamp") for d in (first, last + dt.timedelta(days=1)))
    rows = log.where((F.col("ts") >= start) & (F.col("ts") < end) & day_key(F.col("ts")).isin(keys))
    if "day" in log.columns:
        rows = rows.where(F.col("day").cast("date").isin(days)).drop("day")
    for table, cells in day_partials(rows).items():
        # A row that marks the day replaces what an emptied one held.
        marks = log.sparkSession.createDataFrame([(key,) for key in keys], "day string")
        marked = cells.unionByName(marks, allowMissingColumns=True).repartition("day")
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{table}")


def _read(spark: SparkSession, path: str, table: str, wanted: SummaryFilter) -> DataFrame:
    """The cells that a filter asks for; days are pruned as folders."""
    cells = spark.read.parquet(f"{path}/{table}").withColumn("day", F.col("day").cast("string"))
    cells = cells.where(F.col("day").between(wanted.day_from.isoformat(), wanted.as_of.isoformat()))
    cells = cells.where(F.col("pos" if table == NEWEST else "total").isNotNull())
    for name, asked in (("flow", wanted.flow), ("status", wanted.status)):
        if asked != "all":
            cells = cells.where(F.col(name) == asked)
    if wanted.vendor:
        cells = cells.where(F.contains(F.lower("vendor"), F.lit(wanted.vendor.lower())))
    return cells


def summary_from_days(spark: SparkSession, path: str, wanted: SummaryFilter) -> DataFrame:
    """The summary of :func:`plans.summary.build_summary`, from stored days alone."""
    cells = _read(spark, path, CELLS, wanted).withColumns({"vendor_label": vendor_label(), "reason_label": F.col("reason")})
    added = [F.sum(c).alias(c) for c in _SUMS] + [F.min("first_pos").alias("first_pos")]
    sets = [[F.col("vendor_label")], [F.col("reason_label")], [F.col("day")], []]
    names = ["vendor_label", "reason_label", "day"]
    # grouping_id has a bit for each column; that of the fourth facet, latency, is always set here.
    cube = cells.groupingSets(sets, *[F.col(n) for n in names]).agg((F.grouping_id() * 2 + 1).cast("int").alias("facet"), *added)
    latencies = _read(spark, path, LATENCIES, wanted).groupBy(F.col("latency_ms").alias("latency")).agg(F.sum("total").alias("total"))
    own = 0b1111 ^ (1 << (len(FACETS) - 1 - FACETS.index("latency")))
    cube = cube.unionByName(latencies.withColumn("facet", F.lit(own)), allowMissingColumns=True)
    newest = recent_events(_read(spark, path, NEWEST, wanted), RECENT)
    return summary_of(stage(cube, "summary"), newest, wanted)
