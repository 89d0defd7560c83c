"""Keep a release store up to date from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.release_store import ReleaseStore


def release_stream(
    changes: DataFrame,
    store: ReleaseStore,
    checkpoint: str,
    sequence: str | None = None,
    trigger: dict | None = None,
    keep: int = 2,
) -> StreamingQuery:
    """Start applying a stream of releases. Each row is a release at its position, new or changed; with
    ``removed`` true it says that the release is gone. Of rows of a batch for one position the one with
    the greatest ``sequence`` counts.

    A batch is one change of the store, numbered by the batch, so a batch that is repeated after a
    failure changes nothing twice. The ``keep`` newest versions stay for those who read them."""

    def run(batch: DataFrame, batch_id: int) -> None:
        gone = F.coalesce(F.col("removed"), F.lit(False))
        rows = batch.withColumn("removed", gone) if "removed" in batch.columns else batch.withColumn("removed", F.lit(False))
        if sequence is not None:  # what was said last about a position
            last = rows.groupBy("pos").agg(F.max(sequence).alias("_last"))
            rows = rows.join(last, "pos").where(F.col(sequence).eqNullSafe(F.col("_last"))).drop("_last")
        changed = rows.where(~F.col("removed")).drop("removed", *([sequence] if sequence else []))
        store.apply(changed, rows.where("removed").select("pos"), delta=batch_id)
        store.vacuum(keep)

    return (
        changes.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )
