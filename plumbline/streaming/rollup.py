"""Daily rollup of a stream of events.

State holds one row per day, flow and status of counts that add up, so it stays small
whatever the traffic. Days are those of the session's time zone, as in the batch summary and the
log. A stream emits rows once the watermark has closed their 24 hours of UTC, so a local day may
come in two rows that add up; later rows are dropped. What is still open is in the log: the
same functions over the appended log give every day, today included; ``days.py`` keeps days that late
rows repair.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import day_key
from ..operators.summary import with_rates

COUNTS = ["total", "vendor_not_found", "latency_n", "latency_sum"]
SKETCH = "latency_sketch"
#: Size of a sketch, and how far a rank read from merged ones may be off, as a share of all values.
SKETCH_SIZE, RANK_ERROR = 400, 0.015


def daily_rollup(events: DataFrame, watermark: str = "1 hour", sketch: bool = False) -> DataFrame:
    """Counts per day, flow and status; works on streams and on tables. With ``sketch`` also a quantile
    sketch of the latencies, null where there are none."""
    counted = events.withWatermark("ts", watermark).groupBy(
        F.window("ts", "1 day").alias("w"), day_key(F.col("ts")).alias("day"), "flow", "status"
    )
    more = [F.kll_sketch_agg_bigint(F.col("latency_ms"), F.lit(SKETCH_SIZE)).alias(SKETCH)] if sketch else []
    return counted.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_vendor_found") == 0).alias("vendor_not_found"),
        F.count("latency_ms").alias("latency_n"),
        F.sum("latency_ms").alias("latency_sum"),
        *more,
    ).select("day", "flow", "status", *COUNTS, *([SKETCH] if sketch else []))


def rollup_percentiles(
    rollup: DataFrame,
    percents: dict[str, int],
    day_from: dt.date,
    day_to: dt.date,
    flow: str = "all",
    status: str = "all",
) -> DataFrame:
    """One row: a column per entry of ``percents`` and ``n``, the values they are of, over days of a
    rollup with sketches; null without values. Sketches of days, flows and statuses are merged, the
    log is not read. Ranks are off by ``RANK_ERROR`` of the values at most, with a probability of 99 %
    and more."""
    rows = rollup.where(F.col("day").between(day_from.isoformat(), day_to.isoformat()) & (F.col("latency_n") > 0))
    for name, asked in (("flow", flow), ("status", status)):
        if asked != "all":
            rows = rows.where(F.col(name) == asked)
    merged = rows.agg(F.kll_merge_agg_bigint(SKETCH).alias("merged"), F.coalesce(F.sum("latency_n"), F.lit(0)).alias("n"))
    some = F.col("n") > 0
    read = {name: F.when(some, F.kll_sketch_get_quantile_bigint("merged", F.lit(p / 100.0))) for name, p in percents.items()}
    return merged.select("n", *[value.alias(name) for name, value in read.items()])


def write_rollup(
    rollup: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append closed days to Parquet; the file sink's log makes each appear once."""
    return (
        rollup.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


def append_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    once: tuple[str, ...] = (),
    watermark: str = "1 hour",
) -> StreamingQuery:
    """Append a stream of events to a log partitioned by day. ``once`` names the columns by which a
    source that sends events again can be told: an event is logged when it is first met, and forgotten
    when the ``watermark`` has passed it."""
    if once:
        events = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(once))
    return (
        events.withColumn("day", day_key(F.col("ts")))
        .writeStream.outputMode("append")
        .partitionBy("day")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


def rollup_by_day(rollup: DataFrame) -> DataFrame:
    """Daily totals with rates and mean latency from rollup rows."""
    def of(status):
        return F.sum(F.when(F.col("status") == status, F.col("total")).otherwise(0))

    return with_rates(
        rollup.groupBy("day").agg(
            F.sum("total").alias("total"),
            of("answer").alias("answered"),
            of("abstain").alias("abstained"),
            of("error").alias("errors"),
            F.sum("vendor_not_found").alias("vendor_not_found"),
            F.sum("latency_n").alias("latency_n"),
            F.sum("latency_sum").alias("latency_sum"),
        )
    )
