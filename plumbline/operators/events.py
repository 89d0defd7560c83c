"""The ask log: one event per answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import empty_to_null
from ..schemas import EVENT_COLUMNS

UNKNOWN = "unknown"


def answers_to_events(answers: DataFrame, ts: str, latency_ms: str | None = None) -> DataFrame:
    """Event rows of answer rows. ``ts`` holds the time of the answer; ``pos``, the order
    in which events were logged, is the question id."""
    latency = F.col(latency_ms) if latency_ms else F.lit(None).cast("bigint")
    return normalize_events(
        answers.select(
            F.col("question_id").alias("pos"),
            F.col(ts).alias("ts"),
            "status",
            "flow",
            F.col("logged_vendor").alias("vendor"),
            latency.alias("latency_ms"),
            "reason",
            F.col("is_vendor_found"),
        )
    )


def normalize_events(events: DataFrame) -> DataFrame:
    """The defaults of a logged event: blank status, flow or vendor become ``unknown``, a
    latency must be finite, the vendor flag must be 0 or 1, a blank reason is null."""
    def or_unknown(name):
        return F.coalesce(empty_to_null(F.col(name)), F.lit(UNKNOWN)).alias(name)

    latency = F.col("latency_ms").cast("double")
    finite = latency.isNotNull() & ~F.isnan(latency) & (F.abs(latency) != float("inf"))
    return events.select(
        "pos",
        "ts",
        or_unknown("status"),
        or_unknown("flow"),
        or_unknown("vendor"),
        F.when(finite, F.col("latency_ms")).cast("bigint").alias("latency_ms"),
        empty_to_null(F.col("reason")).alias("reason"),
        F.when(F.col("is_vendor_found").isin(0, 1), F.col("is_vendor_found"))
        .cast("int")
        .alias("is_vendor_found"),
    ).select(*EVENT_COLUMNS)


def retain_last(events: DataFrame, n: int) -> DataFrame:
    """The ``n`` most recently logged events. At scale, prefer retention by day."""
    return events.orderBy(F.desc("pos")).limit(n)


def last_prompts(questions: DataFrame, n: int = 3) -> DataFrame:
    """The newest ``n`` questions that are not blank: ``(question_id, asked_at, prompt)``."""
    from .questions import question_text

    prompts = questions.select(
        "question_id", "asked_at", question_text(questions).alias("prompt")
    ).where(F.col("prompt") != "")
    return prompts.orderBy(F.desc("asked_at"), F.desc("question_id")).limit(n)
