"""Size checks for broadcasts, and staged tables that cut lineage.

Nothing is broadcast on trust. The side of a join that might be small is measured first, as
rows and bytes of text rather than as compressed files; past the bound the same equi-join
shuffles, and adaptive execution splits the partition of a hot key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
ROW_OVERHEAD = 64
#: Bytes of a value of a type that is not named here; all of those are fixed numbers and dates.
FIXED = 8


_run: ContextVar[str | None] = ContextVar("run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one ``spark.checkpoint.dir`` names, else the one
    set with ``setCheckpointDir``. It must be one that every executor can reach; the library
    never chooses one itself."""
    named = _run.get() or spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return named.rstrip("/")


@contextmanager
def run_folder(spark: SparkSession, label: str = "run") -> Iterator[str]:
    """Everything staged inside goes to one new folder, which is yielded. Frames made inside
    read from it: write what they hold before :func:`drop_folder` is called on it."""
    folder = new_folder(spark, label)
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a run's staged tables, wherever they lie."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, work_folder: str | None = None) -> DataFrame:
    """Write a frame once and read it back: later branches scan narrow Parquet columns
    instead of repeating the work, and a lost executor costs no recomputation.

    Each call takes a new folder, to be cleared with the checkpoints. With ``work_folder`` it
    overwrites one there, as a stream does batch after batch.
    """
    spark = df.sparkSession
    path = f"{work_folder}/{label}" if work_folder else new_folder(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, label: str, work: Callable[[], DataFrame]) -> DataFrame:
    """``stage`` of the frame that ``work`` makes; what it has staged on the way is deleted."""
    with run_folder(spark, f"{label}-work") as folder:
        found = work()
    kept = stage(found, label)
    drop_folder(spark, folder)
    return kept


@dataclass(frozen=True)
class Size:
    fits: bool
    longest: int


def payload(value: Column, kind: T.DataType) -> Column | None:
    """Bytes that a value holds beyond its row: texts, binaries, and what lists, maps and structs
    hold of anything. None for a plain number, which the overhead of a row covers."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")
    if isinstance(kind, T.StructType):
        parts = [payload(value.getField(f.name), f.dataType) for f in kind.fields]
        parts = [p for p in parts if p is not None]
        return sum(parts[1:], parts[0]) if parts else None
    if isinstance(kind, T.MapType):
        keys = payload(F.map_keys(value), T.ArrayType(kind.keyType))
        return keys + payload(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.ArrayType):
        slots = F.coalesce(F.size(value), F.lit(0)).cast("bigint") * FIXED
        if payload(F.lit(None), kind.elementType) is None:
            width = len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1
            return slots * width
        each = lambda total, x: total + payload(x, kind.elementType)
        return slots + F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), each), F.lit(0))
    return None


def measure(df: DataFrame, text: str | None = None) -> Size:
    """Rows and bytes of a frame against the bound, and its longest ``text``."""
    texts = {f.name: payload(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
    texts = {c: size for c, size in texts.items() if size is not None}
    longest = F.max(F.length(text)) if text else F.lit(0)
    found = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(longest, F.lit(0)).alias("longest"),
        *[F.coalesce(F.sum(size), F.lit(0)).alias(f"{c}_bytes") for c, size in texts.items()],
    ).first()
    total = sum(found[f"{c}_bytes"] for c in texts) + ROW_OVERHEAD * found["rows"]
    fits = found["rows"] <= BROADCAST_ROWS and total <= BROADCAST_BYTES
    return Size(fits, found["longest"])


def join_side(df: DataFrame) -> DataFrame:
    """A staged frame, hinted for a join: broadcast when it fits, else sort-merge, so that a
    well compressed file is not broadcast by its size on disk."""
    return F.broadcast(df) if measure(df).fits else df.hint("merge")
