"""Sharding by sampled splitters: shards of nearly equal bytes, as ranges of a key.

A row's key is a hash of its text, a hash of its id, and a number of its own, so equal texts lie
together and even rows equal in everything can be parted. Keys are drawn with a probability in
proportion to their rows' sizes; weighted quantiles of the draw split the keys into ranges. One pass
measures the ranges exactly. Ranges that are too full, and those that hold a cut between two shards,
draw again and are subdivided, until each cut is met closely or a single row is in its way. Small
neighbouring ranges are put together again. What the driver holds is a number of splitters that is
bounded by parameters, never keys of all rows.

Documents are then shuffled once, each range to a task of its own, sorted by key, and written to the
shard's folder with their place in the range. Slots follow from the rows counted in each range, which
are read back from the files, so they are those of what was written.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.operators.staging import new_folder, stage

#: Bytes added to each text's for the row itself.
ROW_BYTES = 8
#: Bytes of a range that a task writes, about, and the most ranges; beyond, ranges grow.
RANGE_BYTES, MOST_RANGES = 64 * 1024 * 1024, 65_536
#: Keys drawn for each range, and the share of a shard's bytes by which a cut may be off.
DRAWN, SLACK = 32, 0.001
#: Share of a shard up to which rows of equal texts are kept together.
TOGETHER = 0.02

KEY = ("k1", "k2", "k3")
_LOWEST = -(1 << 63)
_PLACE_BITS = (1 << 33) - 1


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``k1, k2, k3, doc``: the key beside the whole row."""
    whole = F.struct("*").alias("_doc")
    return docs.select(whole, F.monotonically_increasing_id().alias("_row")).select(
        F.xxhash64(F.coalesce(F.col(f"_doc.`{text}`"), F.lit(""))).alias("k1"),
        F.xxhash64(F.col(f"_doc.`{doc_id}`").cast("string")).alias("k2"),
        F.xxhash64("_row").alias("k3"),
        F.col("_doc").alias("doc"),
    )


def _packed(*parts: np.ndarray) -> np.ndarray:
    """Keys as 24 bytes each, which compare as the three numbers do."""
    numbers = np.stack([np.asarray(p, dtype=np.int64) for p in parts], axis=1).view(np.uint64)
    return (numbers ^ np.uint64(1 << 63)).astype(">u8").view("S24").ravel()


def _unpacked(key: bytes) -> tuple[int, ...]:
    return tuple(int(n) for n in (np.frombuffer(key.ljust(24, b"\0"), dtype=">u8") ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64))


def _lots(seed: int) -> Column:
    """A number from 0 to 1 for each key, another one for each seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *KEY), 11) * F.lit(2.0**-53)


class Splitters:
    """Finds the bounds of ranges; ``keys`` has ``k1, k2, k3, size``, written down."""

    def __init__(self, keys: DataFrame, shards: int, range_bytes: int):
        self.keys, self.shards = keys, shards
        told = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
        self.total = told["bytes"]
        self.per_shard = max(1, min(math.ceil(self.total / shards / range_bytes), MOST_RANGES // shards))
        self.target = self.total / (shards * self.per_shard)
        self.bounds = np.empty(0, dtype="S24")
        #: First bound of each range that belongs to the shard after the one before.
        self.cuts = np.empty(0, dtype="S24")
        self.seed = 0

    def _draw(self, wanted: np.ndarray, sizes: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys drawn from the wanted ranges, ``each`` of them about, with the bytes that each stands
        for. Rows larger than a draw stand for themselves."""
        self.seed += 1
        bounds, step = self.bounds, np.where(wanted, np.maximum(sizes, 1) / each, np.inf)
        kind = "k1 bigint, k2 bigint, k3 bigint, size bigint, range bigint"
        schema = to_arrow_schema(T.StructType.fromDDL(kind))

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [batch[c].to_numpy(zero_copy_only=False) for c in KEY]
                at = np.searchsorted(bounds, _packed(*parts), side="right")
                size, lot = (batch[c].to_numpy(zero_copy_only=False) for c in ("size", "lot"))
                drawn = pa.array(lot * step[at] < size)
                columns = [batch[c].filter(drawn) for c in (*KEY, "size")] + [pa.array(at).filter(drawn)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        found = self.keys.select("*", _lots(self.seed).alias("lot")).mapInArrow(work, kind).toArrow()
        keys = _packed(*[found[c].to_numpy() for c in KEY])
        order, ranges = np.argsort(keys, kind="stable"), found["range"].to_numpy()
        return keys[order], np.maximum(found["size"].to_numpy(), step[ranges])[order]

    def _measure(self) -> np.ndarray:
        """Bytes of each range."""
        bounds, kind = self.bounds, "range bigint, bytes bigint"
        schema = to_arrow_schema(T.StructType.fromDDL(kind))

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(bounds) + 1, dtype=np.int64)
            for batch in batches:
                parts = [batch[c].to_numpy(zero_copy_only=False) for c in KEY]
                at = np.searchsorted(bounds, _packed(*parts), side="right")
                np.add.at(sums, at, batch["size"].to_numpy(zero_copy_only=False))
            some = np.nonzero(sums)[0]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], schema=schema)

        found = self.keys.mapInArrow(work, kind).groupBy("range").agg(F.sum("bytes").alias("bytes")).toArrow()
        sizes = np.zeros(len(bounds) + 1, dtype=np.int64)
        sizes[found["range"].to_numpy()] = found["bytes"].to_numpy()
        return sizes

    def find(self) -> Splitters:
        if not self.total:
            return self
        n = self.shards * self.per_shard
        drawn, weight = self._draw(np.array([True]), np.array([self.total]), DRAWN * n)
        upto = np.cumsum(weight)
        self.bounds = np.unique(drawn[np.searchsorted(upto, upto[-1] * np.arange(1, n) / n)])
        sizes = self._measure()
        ideal = self.total * np.arange(1, self.shards) / self.shards
        while True:
            ends = np.cumsum(sizes)
            at = np.searchsorted(ends, ideal)
            off = np.minimum(ends[at] - ideal, ideal - (ends[at] - sizes[at]))
            todo = sizes > 2 * self.target
            todo[at[off > SLACK * self.total / self.shards]] = True
            if not todo.any():
                break
            drawn, _ = self._draw(todo, sizes, DRAWN)
            known = len(self.bounds)
            self.bounds = np.unique(np.concatenate((self.bounds, drawn)))
            if len(self.bounds) == known:  # what remains are single rows
                break
            sizes = self._measure()
        self._cut(ideal, sizes)
        return self

    def _cut(self, ideal: np.ndarray, sizes: np.ndarray) -> None:
        """Chooses the cuts, puts small ranges together."""
        ends = np.cumsum(sizes)[:-1]
        nearest = np.minimum(np.searchsorted(ends, ideal), max(len(ends) - 1, 0))
        if len(ends):
            before = np.maximum(nearest - 1, 0)
            nearest = np.where(np.abs(ends[before] - ideal) <= np.abs(ends[nearest] - ideal), before, nearest)
            edges = []
            for text, _, _ in {_unpacked(key) for key in self.bounds[nearest].tolist()}:
                after = (text + 1, _LOWEST, _LOWEST) if text < (1 << 63) - 1 else (text, (1 << 63) - 1, (1 << 63) - 1)
                edges += [(text, _LOWEST, _LOWEST), after]
            inner = self.bounds[nearest]
            self.bounds = np.unique(np.concatenate((self.bounds, _packed(*np.array(edges, dtype=np.int64).T))))
            sizes = self._measure()
            ends = np.cumsum(sizes)[:-1]
            cuts = []
            for key, wish in zip(inner, ideal):
                text = _unpacked(bytes(key))[0]
                own = np.searchsorted(self.bounds, _packed(*[np.array([n]) for n in (text, _LOWEST, _LOWEST)]))[0]
                upto = np.searchsorted(self.bounds, _packed(*[np.array([n]) for n in (text + 1, _LOWEST, _LOWEST)]))[0] if text < (1 << 63) - 1 else own
                whole = ends[upto] - ends[own] <= TOGETHER * self.total / self.shards
                cuts.append(min((own, upto), key=lambda i: abs(ends[i] - wish)) if whole else np.searchsorted(self.bounds, key))
            chosen = np.maximum.accumulate(np.array(cuts, dtype=np.int64))
        else:
            chosen = np.empty(0, dtype=np.int64)
        self.cuts = self.bounds[chosen]
        kept, held, cut = [], sizes[0], set(chosen.tolist())
        for i, size in enumerate(sizes[1:].tolist()):
            if i in cut or held + size > self.target:
                kept.append(i)
                held = 0
            held += size
        self.bounds = self.bounds[kept]

    def placed(self) -> Column:
        """``(range, shard)`` of a key."""
        bounds, cuts = self.bounds, self.cuts

        @F.pandas_udf("range int, shard int")
        def place(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.DataFrame:
            keys = _packed(k1.to_numpy(), k2.to_numpy(), k3.to_numpy())
            found = {"range": np.searchsorted(bounds, keys, side="right"), "shard": np.searchsorted(cuts, keys, side="right")}
            return pd.DataFrame({name: at.astype(np.int32) for name, at in found.items()})

        return place(*KEY)


def write_shards(
    docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text",
    folder: str | None = None, range_bytes: int = RANGE_BYTES,
) -> str:
    """Writes every row of ``docs`` to one of ``shards`` folders and returns the folder that holds
    them. Shards differ by a row or two and ``SLACK`` in bytes, and by ``TOGETHER`` of a shard where that
    keeps equal texts in one shard; groups of more bytes than that may lie across a cut, in neighbouring
    shards.

    A null text has no bytes and counts as an empty one for its key. Null ids, repeated rows and
    rows equal in every column are rows like others: none is lost, and a crowd of them is split
    like any other range. Columns keep their names inside ``doc``, so names cannot clash. With fewer
    rows than shards some shards are empty; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    keyed = _keyed(docs, doc_id, text)
    keys = stage(keyed.select(*KEY, text_bytes(F.col(f"doc.`{text}`")).alias("size")), "shard-keys")
    split = Splitters(keys, shards, range_bytes).find()
    ranged = keyed.withColumn("at", split.placed()).select(*KEY, "doc", "at.range", "at.shard")
    dealt = ranged.repartitionById(len(split.bounds) + 1, "range").sortWithinPartitions(*KEY)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_BITS))
    dealt.select("shard", "range", place.alias("place"), "doc").write.partitionBy("shard").parquet(folder)
    return folder


def read_shards(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """``(doc, shard, slot)`` of what was written from ``docs``: ``doc`` has its columns, and slots
    count up from 0 in every shard without a gap, in the order of the keys."""
    doc = T.StructField("doc", docs.schema)
    fields = [T.StructField(n, k) for n, k in (("range", T.IntegerType()), ("place", T.LongType()))]
    written = spark.read.schema(T.StructType([*fields, doc, T.StructField("shard", T.IntegerType())])).parquet(folder)
    counts = written.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("shard", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    bases = stage(bases, "shard-ranges")  # a row for each range, at most a few times MOST_RANGES
    return written.join(F.broadcast(bases), ["shard", "range"]).select("doc", "shard", (F.col("base") + F.col("place")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` written to shards and read back: ``(doc, shard, slot)``."""
    return read_shards(docs.sparkSession, write_shards(docs, shards, doc_id, text, **options), docs)
