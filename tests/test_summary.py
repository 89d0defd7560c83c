import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import summary
from plumbline.operators.percentiles import exact_percentiles
from plumbline.operators.summary import SummaryFilter
from plumbline.plans.summary import build_summary

DAY = dt.date(2026, 3, 30)
FIELDS = (
    "pos long, at string, status string, flow string, vendor string, latency_ms long, "
    "reason string, is_vendor_found int"
)


@pytest.fixture(scope="module")
def log(spark):
    def make(*rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FIELDS)
        return df.withColumn("ts", F.col("at").cast("timestamp")).drop("at")

    return make


def test_options_are_clamped():
    assert SummaryFilter(DAY, range_days=0).range_days == 1
    assert SummaryFilter(DAY, range_days=400).range_days == 90
    texts = ("7", "7 days", "-3", "soon", "", None)
    assert [SummaryFilter(DAY, range_days=t).range_days for t in texts] == [7, 7, 1, 1, 1, 1]
    odd = SummaryFilter(DAY, flow="unknown", status="ANSWER", vendor=None)
    assert (odd.flow, odd.status, odd.vendor) == ("all", "answer", "")
    assert SummaryFilter(DAY, range_days=3).day_from == dt.date(2026, 3, 28)


def test_empty_log(log):
    row = build_summary(log(("2026-03-30", *[None] * 6)).where("false"), SummaryFilter(DAY, 2)).first()
    assert (row["total_questions"], row["abstain_rate"], row["answer_rate"]) == (0, 0.0, 0.0)
    assert tuple(row["latency_ms"]) == (None, None, None)
    assert [tuple(b) for b in row["time_buckets"]] == [("2026-03-29", 0), ("2026-03-30", 0)]
    assert (row["max_vendor_count"], row["max_day_count"]) == (1, 1)
    assert row["top_vendors"] == [] and row["recent"] == []


def test_summary(log):
    events = log(
        ("2026-03-29 23:59:59", "answer", "os", "B", 1, "answered", 1),
        ("2026-03-30 10:00:00", "abstain", "patch", " a ", 2, None, 0),
        ("2026-03-30 10:00:00", "error", "os", "", 3, "", None),
        ("2026-03-30 09:00:00", "abstain", "patch", "a", 10, "x", 0),
        ("2026-03-28 10:00:00", "answer", "os", "old", 1, None, 1),
        ("2026-03-31 00:00:00", "answer", "os", "next", 1, None, 1),
        ("2026-03-30 08:00:00", "answer", "os", "b", None, "answered", 1),
    )
    row = build_summary(events, SummaryFilter(DAY, 2)).first()
    assert row["total_questions"] == 5 and row["abstain_rate"] == 40.0
    assert tuple(row["latency_ms"]) == (2, 10, 4.0)
    assert [tuple(v) for v in row["top_vendors"]] == [("a", 2), ("B", 1), ("unknown", 1), ("b", 1)]
    assert [tuple(v) for v in row["top_reasons"]] == [("unknown", 1), ("error", 1), ("x", 1)]
    assert [tuple(b) for b in row["time_buckets"]] == [("2026-03-29", 1), ("2026-03-30", 4)]
    assert [e["vendor"] for e in row["recent"]] == [" a ", "", "a", "b", "B"]
    assert row["vendor_not_found_count"] == 2 and row["patch_query_count"] == 2
    kept = SummaryFilter(DAY, 2, flow="patch", status="abstain", vendor="A")
    assert build_summary(events, kept).first()["total_questions"] == 2


def test_rates_round_half_up(spark):
    from plumbline.functions.numbers import mean, percent

    rows = spark.createDataFrame(
        [(1, 3), (2, 3), (1, 8), (3, 4000), (0, 0), (10**15 + 1, 3 * 10**15)], "a long, n long"
    ).select(percent(F.col("a"), F.col("n")), mean(F.col("a"), F.col("n")))
    assert [tuple(r) for r in rows.collect()] == [
        (33.33, 0.33), (66.67, 0.67), (12.5, 0.13), (0.08, 0.0), (0.0, None), (33.33, 0.33),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_are_nearest_rank(spark, seed):
    pick = random.Random(seed)
    rows = [
        (g, pick.choice([None, pick.randint(0, 50), pick.randint(0, 10**6), 70_000]))
        for g in "abc"
        for _ in range(pick.randint(1, 300))
    ] + [("d", None), ("e", 1), ("e", 2), ("e", 3), ("e", 10)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = exact_percentiles(df, "v", {"p50": 50, "p95": 95, "p100": 100}, ("g",)).collect()
    expected = {}
    for group in {g for g, _ in rows}:
        values = sorted(v for g, v in rows if g == group and v is not None)
        if values:
            at = [values[math.ceil(p / 100 * len(values)) - 1] for p in (50, 95, 100)]
            expected[group] = tuple(at)
    assert {r["g"]: tuple(r)[1:] for r in got} == expected
    weighted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    again = exact_percentiles(weighted, "v", {"p95": 95}, ("g",), weight="n").collect()
    assert {r["g"]: r["p95"] for r in again} == {g: e[1] for g, e in expected.items()}


def test_today_counts_events_without_a_time(log):
    events = log(
        ("2026-03-30 10:00:00", "answer", "os", "a", 1, None, 1),
        (None, "answer", "os", "b", 1, None, 1),
        ("2026-03-29 10:00:00", "answer", "os", "c", 1, None, 1),
        ("2026-03-30 11:00:00", "answer", "os", "  ", 1, None, 1),
        ("2026-03-30 11:00:00", "answer", "os", "b", 1, None, 1),
    )
    got = [tuple(r) for r in summary.today_top_vendors(events, DAY).collect()]
    assert got[0] == ("b", 2) and set(got[1:]) == {("Unknown", 1), ("a", 1)}


def test_bar_widths(log):
    events = log(*[("2026-03-30", "answer", "os", v, 1, None, 1) for v in "aab"])
    rows = summary.bar_widths(summary.top_vendors(events)).collect()
    assert {(r["vendor"], r["max_count"], r["width"]) for r in rows} == {
        ("a", 2, 100.0), ("b", 2, 50.0),
    }
