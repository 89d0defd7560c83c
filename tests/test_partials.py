"""The summary from stored days, and percentiles merged from sketches."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.percentiles import exact_percentiles
from plumbline.operators.summary import SummaryFilter
from plumbline.plans.partials import refresh_days, summary_from_days
from plumbline.plans.summary import build_summary
from plumbline.sources import event_log
from plumbline.streaming.days import days_stream
from plumbline.streaming.rollup import RANK_ERROR, append_stream, daily_rollup, rollup_percentiles, write_rollup

DAY = dt.date(2024, 1, 10)
KIND = "pos long, ts timestamp, status string, flow string, vendor string, latency_ms long, reason string, is_vendor_found int"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = []
    for pos in range(1500):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(240), seconds=rng.choice([0, 0, 7]))
        rows.append((
            pos, at, rng.choice(["answer", "abstain", "error", "odd"]), rng.choice(["os", "patch", "unknown"]),
            rng.choice([None, "", " A ", "A", "b", "B"]), rng.choice([None, rng.randrange(200_000)]),
            rng.choice([None, "", "no_results"]), rng.choice([0, 1, None]),
        ))
    return spark.createDataFrame(rows, KIND)


FILTERS = [
    SummaryFilter(DAY, 10), SummaryFilter(DAY, 3, flow="os"), SummaryFilter(DAY, 10, status="abstain", vendor="b"),
    SummaryFilter(dt.date(2023, 5, 5), 2), SummaryFilter(DAY, 30, vendor="nobody"),
]


def test_summaries_equal_those_of_the_log(spark, log, tmp_path):
    refresh_days(log, str(tmp_path), [dt.date(2024, 1, d) for d in range(1, 11)])
    for wanted in FILTERS:
        assert summary_from_days(spark, str(tmp_path), wanted).collect() == build_summary(log, wanted).collect()


def test_a_refresh_replaces_one_day_and_reads_one(spark, log, tmp_path):
    path, stored = str(tmp_path / "days"), str(tmp_path / "log")
    event_log.append_events(log.where("pos % 2 = 0 or ts < '2024-01-09'"), stored)
    refresh_days(event_log.read_events(spark, stored), path, [dt.date(2024, 1, d) for d in range(1, 11)])

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    event_log.append_events(log.where("pos % 2 = 1 and ts >= '2024-01-10'"), stored)
    event_log.append_events(log.where("pos % 2 = 1 and ts >= '2024-01-09' and ts < '2024-01-10'"), stored)
    now = event_log.read_events(spark, stored)
    refresh_days(now, path, [DAY])
    assert {f.split("day=")[1][:10] for f in before ^ files()} == {"2024-01-10"}
    refresh_days(now, path, [dt.date(2024, 1, 9)])
    assert summary_from_days(spark, path, FILTERS[0]).collect() == build_summary(log, FILTERS[0]).collect()


def test_an_emptied_day_holds_nothing(spark, log, tmp_path):
    days = [DAY, dt.date(2024, 1, 9)]
    refresh_days(log, str(tmp_path), days)
    refresh_days(log.where("ts < '2024-01-10'"), str(tmp_path), [DAY])
    rest = log.where("ts >= '2024-01-09' and ts < '2024-01-10'")
    assert summary_from_days(spark, str(tmp_path), FILTERS[0]).collect() == build_summary(rest, FILTERS[0]).collect()


def test_late_events_repair_their_days(spark, log, tmp_path):
    """Three batches, the last of them weeks late and sent again after a restart."""
    inbox, stored, path = (str(tmp_path / n) for n in ("inbox", "log", "days"))
    parts = [log.where("ts >= '2024-01-05'"), log.where("ts < '2024-01-05' and pos % 9 > 0"), log.where("ts < '2024-01-05' and pos % 9 = 0")]

    def run(checkpoint):
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        days_stream(stream, stored, path, str(tmp_path / checkpoint), {"availableNow": True}).awaitTermination()

    for part in parts:
        part.coalesce(1).write.mode("append").parquet(inbox)
        run("first")
    for _ in range(2):
        assert summary_from_days(spark, path, FILTERS[0]).collect() == build_summary(log, FILTERS[0]).collect()
        run("again")  # the same batches once more


def test_events_sent_again_are_logged_once(spark, log, tmp_path):
    inbox, path = str(tmp_path / "inbox"), str(tmp_path / "log")
    for _ in range(2):
        log.repartition(2).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        checkpoint = str(tmp_path / "checkpoint")
        append_stream(stream, path, checkpoint, {"availableNow": True}, once=("pos",), watermark="30 days").awaitTermination()
    got = event_log.read_events(spark, path).select(*log.columns)
    assert got.count() == log.count() and got.exceptAll(log).count() == 0


def test_percentiles_of_a_streamed_rollup(spark, log, tmp_path):
    """Sketches of closed days, from a stream, merged; ranks against the exact ones."""
    inbox, path = str(tmp_path / "inbox"), str(tmp_path / "rollup")
    log.write.parquet(inbox)
    stream = spark.readStream.schema(log.schema).parquet(inbox)
    write_rollup(daily_rollup(stream, sketch=True), path, str(tmp_path / "checkpoint"), {"availableNow": True}).awaitTermination()
    rollup = spark.read.parquet(path)
    percents = {"p5": 5, "p50": 50, "p95": 95}
    first, last = dt.date(2024, 1, 2), dt.date(2024, 1, 8)
    for flow in ("all", "patch"):
        got = rollup_percentiles(rollup, percents, first, last, flow=flow).first()
        kept = log.where("ts >= '2024-01-02' and ts < '2024-01-09' and latency_ms is not null")
        kept = kept if flow == "all" else kept.where(F.col("flow") == flow)
        assert got["n"] == kept.count()
        bounds = {f"{n}_{s}": max(0, p + s * 100 * RANK_ERROR) for n, p in percents.items() for s in (-1, 1)}
        exact = exact_percentiles(kept, "latency_ms", bounds).first()
        assert all(exact[f"{n}_-1"] <= got[n] <= exact[f"{n}_1"] for n in percents)
    none = rollup_percentiles(rollup, percents, dt.date(2020, 1, 1), dt.date(2020, 1, 2)).first()
    assert none["n"] == 0 and none["p50"] is None
