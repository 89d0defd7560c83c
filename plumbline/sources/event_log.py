"""The event log: reading stored JSON lines, appending Parquet by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import day_key
from ..operators.events import normalize_events, retain_last
from ..schemas import EVENT_COLUMNS, EVENT_LINE

_CORRUPT = "_corrupt"


def decode_events(lines: DataFrame, keep_last: int | None = None) -> DataFrame:
    """Events of stored lines ``(stored_index, line)``. The list is newest first, so the
    position is the negated index. Lines that are no JSON object are dropped."""
    schema = T.StructType([*EVENT_LINE.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    decoded = (
        lines.where(F.startswith(F.ltrim("line"), F.lit("{")))
        .select(
            (-F.col("stored_index")).alias("pos"),
            F.from_json("line", schema, options).alias("e"),
        )
        .where(F.col("e").isNotNull() & F.col(f"e.{_CORRUPT}").isNull())
        .select(
            "pos",
            F.timestamp_millis(F.col("e.ts").try_cast("bigint")).alias("ts"),
            "e.status",
            "e.flow",
            "e.vendor",
            F.col("e.latencyMs").try_cast("double").alias("latency_ms"),
            "e.reason",
            F.col("e.isVendorFound").try_cast("int").alias("is_vendor_found"),
        )
    )
    events = normalize_events(decoded)
    return events if keep_last is None else retain_last(events, keep_last)


def append_events(events: DataFrame, path: str) -> None:
    """Append to a log partitioned by day, which is how summaries prune it."""
    events.withColumn("day", day_key(F.col("ts"))).write.mode("append").partitionBy("day").parquet(
        path
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*EVENT_COLUMNS, "day")
