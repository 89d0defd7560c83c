"""The dashboard summary as one nested row.

The filtered log is read once: grouping sets count it by vendor, reason, day, latency and in
total in a single partial aggregation, and that small table is staged. The recent events are
a second scan that keeps twelve rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_key
from ..operators.percentiles import exact_percentiles
from ..operators.staging import stage
from ..operators.summary import (
    RECENT,
    TOP_REASONS,
    TOP_VENDORS,
    SummaryFilter,
    count_columns,
    day_keys,
    filter_events,
    reason_label,
    recent_events,
    vendor_label,
    with_rates,
)

# One grouping set per facet, and the grouping_id Spark gives it (first column, high bit).
FACETS = ["vendor_label", "reason_label", "day", "latency"]
_ID = {name: 0b1111 ^ (1 << (len(FACETS) - 1 - i)) for i, name in enumerate(FACETS)}
_TOTAL = 0b1111


def summary_cube(events: DataFrame) -> DataFrame:
    """Counts by each facet and in total; ``facet`` is the grouping id of a row."""
    rows = events.withColumns(
        {
            "vendor_label": vendor_label(),
            "reason_label": reason_label(),
            "day": day_key(F.col("ts")),
            "latency": F.col("latency_ms"),
        }
    )
    sets = [[F.col(name)] for name in FACETS] + [[]]
    return rows.groupingSets(sets, *[F.col(n) for n in FACETS]).agg(
        F.grouping_id().cast("int").alias("facet"), *count_columns()
    )


def _facet(cube: DataFrame, name: str) -> DataFrame:
    return cube.where((F.col("facet") == _ID[name]) & F.col(name).isNotNull())


def _ranked(rows: DataFrame, label: str, order: list, k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k).select(
        F.col(label).alias("label"), F.col("total").alias("count"), "first_pos"
    )


def _listed(tag: str, item: Column) -> Column:
    """The items of one tagged list, sorted by their sort key."""
    return F.array_sort(F.collect_list(F.when(F.col("tag") == tag, item)))


def build_summary(events: DataFrame, wanted: SummaryFilter) -> DataFrame:
    """One row: the filter, counts, rates, latency, top lists, day buckets, KPIs, recent."""
    kept = filter_events(events, wanted)
    return summary_of(stage(summary_cube(kept), "summary"), recent_events(kept, RECENT), wanted)


def summary_of(cube: DataFrame, newest: DataFrame, wanted: SummaryFilter) -> DataFrame:
    """The summary from counts by facet and the newest events."""
    totals = with_rates(cube.where(F.col("facet") == _TOTAL))
    by_count = [F.desc("total"), "first_pos"]
    vendors = _ranked(_facet(cube, "vendor_label"), "vendor_label", by_count, TOP_VENDORS)
    reasons = _ranked(_facet(cube, "reason_label"), "reason_label", by_count, TOP_REASONS)
    days = day_keys(cube, wanted).join(
        _facet(cube, "day").select("day", F.col("total").alias("count")), "day", "left"
    )
    days = days.select(F.col("day").alias("label"), F.coalesce("count", F.lit(0)).alias("count"))
    latency = exact_percentiles(
        _facet(cube, "latency"), "latency", {"p50": 50, "p95": 95}, weight="total"
    )
    recent = newest.select(
        F.struct(
            F.unix_millis("ts").alias("ts"),
            "status", "flow", "vendor", "latency_ms", "reason", "is_vendor_found", "pos",
            F.unix_micros("ts").alias("at"),
        ).alias("event")
    )

    # A few dozen tagged rows at most: totals, lists, days and recent events.
    rows = totals.select(F.lit("totals").alias("tag"), F.struct("*").alias("totals"))
    for tag, part in (("vendor", vendors), ("reason", reasons), ("day", days)):
        rows = rows.unionByName(
            part.withColumn("tag", F.lit(tag)), allowMissingColumns=True
        )
    rows = rows.unionByName(
        latency.withColumn("tag", F.lit("latency")), allowMissingColumns=True
    ).unionByName(recent.withColumn("tag", F.lit("recent")), allowMissingColumns=True)

    by_size = F.struct((-F.col("count")).alias("less"), F.col("first_pos"), F.col("label"))
    event = F.col("event")
    whole = rows.agg(
        F.max_by("totals", F.when(F.col("tag") == "totals", 1)).alias("t"),
        F.max("p50").alias("p50"),
        F.max("p95").alias("p95"),
        _listed("vendor", by_size).alias("vendors"),
        _listed("reason", by_size).alias("reasons"),
        _listed("day", F.struct("label", "count")).alias("days"),
        _listed("recent", F.struct(-event["at"], event["pos"], event)).alias("recent"),
    )

    def top(name, as_name):
        return F.transform(
            name, lambda x: F.struct(x["label"].alias(as_name), (-x["less"]).alias("count"))
        )

    def n(name):
        return F.coalesce(F.col(f"t.{name}"), F.lit(0))

    def most(items):
        return F.greatest(F.array_max(F.transform(items, lambda x: x["count"])), F.lit(1))

    whole = whole.withColumns(
        {
            "top_vendors": top("vendors", "vendor"),
            "top_reasons": top("reasons", "reason"),
            "time_buckets": F.transform(
                "days", lambda x: F.struct(x["label"].alias("day"), x["count"].alias("count"))
            ),
        }
    )
    return whole.select(
        F.lit(wanted.range_days).alias("range_days"),
        F.lit(wanted.day_from.isoformat()).alias("day_from"),
        F.lit(wanted.as_of.isoformat()).alias("day_to"),
        F.struct(
            F.lit(wanted.flow).alias("flow"),
            F.lit(wanted.status).alias("status"),
            F.lit(wanted.vendor or None).cast("string").alias("vendor"),
        ).alias("filters"),
        n("total").alias("total_questions"),
        n("answered").alias("answered_count"),
        n("abstained").alias("abstain_count"),
        n("errors").alias("error_count"),
        F.coalesce("t.abstain_rate", F.lit(0.0)).alias("abstain_rate"),
        F.coalesce("t.answer_rate", F.lit(0.0)).alias("answer_rate"),
        F.struct("p50", "p95", F.col("t.latency_mean").alias("average")).alias("latency_ms"),
        "top_vendors",
        "top_reasons",
        "time_buckets",
        most(F.col("top_vendors")).alias("max_vendor_count"),
        most(F.col("time_buckets")).alias("max_day_count"),
        n("answered").alias("queries_answered"),
        n("abstained").alias("queries_abstain"),
        n("vendor_not_found").alias("vendor_not_found_count"),
        n("os_queries").alias("os_version_query_count"),
        n("patch_queries").alias("patch_query_count"),
        n("answered").alias("responded_count"),
        n("abstained").alias("abstain_count_kpi"),
        n("os_queries").alias("os_query_count"),
        F.transform("recent", lambda x: x["event"].dropFields("pos", "at")).alias("recent"),
    )
