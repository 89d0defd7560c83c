"""Keep the log and the stored days up to date from a stream of events, late ones included.

Nothing is dropped for being late: a batch adds its events to the log, by day and batch, and the
cells of just the days that it brought are computed again from the log. A batch that is repeated
writes the same files and the same cells.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import day_key
from ..plans.partials import refresh_days


def days_stream(
    events: DataFrame, log: str, days: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Start keeping the log at ``log`` and the cells at ``days``, for
    :func:`plans.partials.summary_from_days`. Events without a time are left out, as in summaries."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col("ts").isNotNull()).withColumns({"day": day_key(F.col("ts")), "batch": F.lit(batch_id)})
        writer = rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch").parquet(log)
        whole = spark.read.schema(rows.schema).parquet(log)
        brought = whole.where(F.col("batch") == batch_id).select(F.col("day").cast("string")).distinct()
        keys = [dt.date.fromisoformat(row["day"]) for row in brought.collect()]  # folders, a row for each day
        refresh_days(whole.drop("batch"), days, keys)

    return (
        events.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )
