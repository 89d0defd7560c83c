"""The last few prompts of a stream.

A stream cannot be sorted, so each micro-batch merges its newest prompts with those of the
batch before and writes them to its own folder. A replayed batch merges with the same
predecessor and writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import last_prompts

_COLUMNS = "question_id long, asked_at timestamp, prompt string"


def prompts_stream(
    questions: DataFrame, path: str, checkpoint: str, n: int = 3, trigger: dict | None = None
) -> StreamingQuery:
    def merge(batch: DataFrame, batch_id: int) -> None:
        newest = last_prompts(batch, n)
        if batch_id > 0:
            before = batch.sparkSession.read.schema(_COLUMNS).parquet(f"{path}/batch={batch_id - 1}")
            kept = before.select("question_id", "asked_at", F.col("prompt").alias("question"))
            newest = last_prompts(
                newest.withColumnRenamed("prompt", "question").unionByName(kept), n
            )
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        questions.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_COLUMNS}, batch long").parquet(path)


def current_prompts(spark: SparkSession, path: str) -> DataFrame:
    """The prompts after the last batch."""
    rows = _read(spark, path)
    last = rows.agg(F.max("batch")).scalar()
    return rows.where(F.col("batch") == last).drop("batch")
