"""Answer questions as they arrive.

Answering folds texts before it joins, which a single streaming plan cannot do, so every
micro-batch runs the batch plan. A batch writes its own folder and overwrites it when it is
replayed: answers and events appear once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import answers_to_events
from ..operators.release_store import ReleaseStore
from ..operators.staging import stage
from ..plans.answer import Options, answer_questions, build_index


def answer_stream(
    questions: DataFrame,
    releases: DataFrame | Callable[[], DataFrame] | ReleaseStore,
    vendor_names: DataFrame | Callable[[], DataFrame],
    answers_path: str,
    checkpoint: str,
    events_path: str | None = None,
    options: Options = Options(),
    trigger: dict | None = None,
    refresh_every: int | None = None,
    names_every: int | None = None,
) -> StreamingQuery:
    """Start answering a stream of ``(question_id, asked_at, question, …)``. The latency of
    an event is the time from asking to the run of its batch.

    The releases are indexed when the stream starts and, with ``refresh_every``, again after
    that many batches; give functions that read them and the vendor names to see what was added
    meanwhile. Two index folders are written in turns.

    A release store is read in its newest version by every batch: its index is kept up by whoever
    changes it, and of the releases a batch reads the ranges of positions that it answers with.
    Names have a clock of their own: ``names_every`` batches, or those of ``refresh_every``."""
    load = releases if callable(releases) else lambda: releases
    load_names = vendor_names if callable(vendor_names) else lambda: vendor_names
    state = {"batches": 0}

    def due(every: int | None) -> bool:
        return not state["batches"] or bool(every) and state["batches"] % every == 0

    def evidence(work: str):
        if due(names_every or refresh_every):
            state["names"] = load_names()
        if isinstance(releases, ReleaseStore):
            state["releases"] = releases.snapshot()
            state["index"] = state["releases"].index()
        elif due(refresh_every):
            state["releases"] = load()
            turn = state["built"] = 1 - state.get("built", 1)  # the other one is still in use
            state["index"] = build_index(state["releases"], options, work_folder=f"{work}/index-{turn}")
        state["batches"] += 1
        return state["releases"], state["index"], state["names"]

    def run(batch: DataFrame, batch_id: int) -> None:
        folder, work = f"{answers_path}/batch={batch_id}", f"{answers_path}/_work"
        known, index, names = evidence(work)
        answered = answer_questions(
            stage(batch, "batch", work),  # read from the source once
            known,
            names,
            options,
            keep=("asked_at",),
            index=index,
            work_folder=work,
        )
        answered.withColumn("answered_at", F.current_timestamp()).write.mode("overwrite").parquet(
            folder
        )
        if events_path is None:
            return
        written = batch.sparkSession.read.parquet(folder).withColumn(
            "waited", F.unix_millis("answered_at") - F.unix_millis("asked_at")
        )
        answers_to_events(written, "answered_at", "waited").write.mode("overwrite").parquet(
            f"{events_path}/batch={batch_id}"
        )

    return (
        questions.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )
