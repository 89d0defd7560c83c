"""Ask-log analytics: filters, counts, rates, top lists, day buckets, recent events."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_key
from ..functions.numbers import mean, percent
from ..functions.text import empty_to_null, strip

MAX_RANGE_DAYS = 90
TOP_VENDORS, TOP_REASONS, RECENT, TODAY_VENDORS = 8, 6, 12, 3
FLOWS = ("all", "os", "patch")
STATUSES = ("all", "answer", "abstain", "error")


@dataclass(frozen=True)
class SummaryFilter:
    """Which events to summarise. ``as_of`` is the last day; values outside the known
    flows and statuses mean ``all``. ``range_days``, also as text, is held between 1 and 90
    days without a warning: a longer range is cut to its last 90 days."""

    as_of: dt.date
    range_days: int = 1
    flow: str = "all"
    status: str = "all"
    vendor: str = ""

    def __post_init__(self):
        leading = re.match(r"\s*[+-]?\d+", str(self.range_days))
        days = min(MAX_RANGE_DAYS, max(1, int(leading.group()) if leading else 1))
        object.__setattr__(self, "range_days", days)
        for name, known in (("flow", FLOWS), ("status", STATUSES)):
            value = str(getattr(self, name) or "all").lower()
            object.__setattr__(self, name, value if value in known else "all")
        object.__setattr__(self, "vendor", str(self.vendor or "").strip())

    @property
    def day_from(self) -> dt.date:
        return self.as_of - dt.timedelta(days=self.range_days - 1)


def filter_events(events: DataFrame, wanted: SummaryFilter) -> DataFrame:
    """Events in the day range with the asked flow, status and vendor text. The range is
    compared on ``ts`` itself, so it prunes files."""
    start = F.lit(wanted.day_from.isoformat()).cast("timestamp")
    end = F.lit((wanted.as_of + dt.timedelta(days=1)).isoformat()).cast("timestamp")
    kept = events.where((F.col("ts") >= start) & (F.col("ts") < end))
    if "day" in events.columns:  # a log partitioned by day
        kept = kept.where(F.col("day").cast("date").between(wanted.day_from, wanted.as_of))
    if wanted.flow != "all":
        kept = kept.where(F.col("flow") == wanted.flow)
    if wanted.status != "all":
        kept = kept.where(F.col("status") == wanted.status)
    if wanted.vendor:
        kept = kept.where(F.contains(F.lower("vendor"), F.lit(wanted.vendor.lower())))
    return kept


def vendor_label() -> Column:
    return F.coalesce(empty_to_null(strip("vendor")), F.lit("unknown"))


def reason_label() -> Column:
    """The reason of an abstention or error; null for other events."""
    missing = F.when(F.col("status") == "error", "error").otherwise("unknown")
    return F.when(
        F.col("status").isin("abstain", "error"),
        F.coalesce(empty_to_null(F.col("reason")), missing),
    )


def count_columns() -> list[Column]:
    """Partial counts that add up across groups."""
    status = F.col("status")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "answer").alias("answered"),
        F.count_if(status == "abstain").alias("abstained"),
        F.count_if(status == "error").alias("errors"),
        F.count_if(F.col("is_vendor_found") == 0).alias("vendor_not_found"),
        F.count_if(F.col("flow") == "os").alias("os_queries"),
        F.count_if(F.col("flow") == "patch").alias("patch_queries"),
        F.count("latency_ms").alias("latency_n"),
        F.sum("latency_ms").alias("latency_sum"),
        F.min("pos").alias("first_pos"),
    ]


def summary_counts(events: DataFrame) -> DataFrame:
    """One row: totals by status with abstain and answer rates."""
    return with_rates(events.agg(*count_columns())).select(
        "total", "answered", "abstained", "errors", "abstain_rate", "answer_rate"
    )


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "abstain_rate": percent(F.col("abstained"), F.col("total")),
            "answer_rate": percent(F.col("answered"), F.col("total")),
            "latency_mean": mean(F.col("latency_sum"), F.col("latency_n")),
        }
    )


def kpi_breakdown(events: DataFrame) -> DataFrame:
    """One row of counts; the last three repeat earlier ones under their old names."""
    return events.agg(*count_columns()).select(
        F.col("answered").alias("queries_answered"),
        F.col("abstained").alias("queries_abstain"),
        F.col("vendor_not_found").alias("vendor_not_found_count"),
        F.col("os_queries").alias("os_version_query_count"),
        F.col("patch_queries").alias("patch_query_count"),
        F.col("answered").alias("responded_count"),
        F.col("abstained").alias("abstain_count_kpi"),
        F.col("os_queries").alias("os_query_count"),
    )


def _top(counted: DataFrame, k: int) -> DataFrame:
    return counted.orderBy(F.desc("count"), "first_pos").limit(k)


def top_vendors(events: DataFrame, k: int = TOP_VENDORS) -> DataFrame:
    """The ``k`` vendors asked for most; ties go to the one seen first."""
    counted = events.groupBy(vendor_label().alias("vendor")).agg(
        F.count(F.lit(1)).alias("count"), F.min("pos").alias("first_pos")
    )
    return _top(counted, k)


def top_reasons(events: DataFrame, k: int = TOP_REASONS) -> DataFrame:
    """The ``k`` most frequent reasons of abstentions and errors."""
    counted = (
        events.groupBy(reason_label().alias("reason"))
        .agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("first_pos"))
        .where(F.col("reason").isNotNull())
    )
    return _top(counted, k)


def day_keys(df: DataFrame, wanted: SummaryFilter) -> DataFrame:
    """One row per day of the range."""
    span = f"sequence(date'{wanted.day_from}', date'{wanted.as_of}')"
    return (
        df.sparkSession.range(1)
        .select(F.explode(F.expr(span)).alias("date"))
        .select(F.date_format("date", "yyyy-MM-dd").alias("day"))
    )


def daily_counts(events: DataFrame, wanted: SummaryFilter) -> DataFrame:
    """Events per day of the range, days without any included."""
    counted = events.groupBy(day_key(F.col("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("count")
    )
    return day_keys(events, wanted).join(counted, "day", "left").fillna(0, ["count"])


def bar_widths(counted: DataFrame) -> DataFrame:
    """Add the largest count (at least 1) and each row's share of it in percent."""
    largest = counted.agg(F.greatest(F.max("count"), F.lit(1))).scalar()
    return counted.withColumn("max_count", largest).withColumn(
        "width", F.col("count") / F.col("max_count") * 100.0
    )


def recent_events(events: DataFrame, n: int = RECENT) -> DataFrame:
    """The newest events; of the same moment, the earlier logged first."""
    return events.orderBy(F.desc("ts"), "pos").limit(n)


def today_top_vendors(
    events: DataFrame, as_of: dt.date, k: int = TODAY_VENDORS, recent: int | None = None
) -> DataFrame:
    """Vendors of one day, or of its events among the ``recent`` newest of the log.
    An event without a time counts as that day's; ties go to the one listed first."""
    rows = events if recent is None else recent_events(events, recent)
    age = F.struct(-F.unix_micros("ts"), F.col("pos"))
    counted = (
        rows.where(F.coalesce(F.to_date("ts"), F.lit(as_of)) == F.lit(as_of))
        .groupBy(F.coalesce(empty_to_null(strip("vendor")), F.lit("Unknown")).alias("vendor"))
        .agg(F.count(F.lit(1)).alias("count"), F.min(age).alias("first_listed"))
    )
    return counted.orderBy(F.desc("count"), "first_listed").limit(k).select("vendor", "count")


def last_entries(questions: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` questions of each user, ``recency`` 1 being the newest. The rank limit
    runs before the shuffle too, so a busy user sends ``n`` rows per task."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("asked_at"), F.desc("question_id"))
    return questions.withColumn("recency", F.row_number().over(newest)).where(
        F.col("recency") <= n
    )
