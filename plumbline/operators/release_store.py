"""Releases kept for lookups, changed in place.

A store holds four tables. ``evidence`` has the releases, in parts by range of position, so an answer
reads the ranges its releases lie in. ``postings`` has every entry that a release makes (see
``index.py``), in parts by a hash of the key; ``gone`` has the positions whose earlier postings no longer
count. ``index`` has the best entry and the number of releases per key, rule and date, in the same
parts as the postings.

A change brings new or changed releases and the positions of removed ones. Only parts that it touches
are read. Minima and counts of added entries are merged into the stored index, entries of releases that
go are taken off its counts; where the best entry itself goes, just that key, rule and date is folded
again, from the postings of its part. Postings only ever gain rows: a part is written anew when it has
gathered ``SEGMENTS`` segments, or by :meth:`ReleaseStore.compact`. Evidence ranges and index parts are
written anew when a row of theirs changes.

Segments are never changed. A version is a manifest that names the segments of each part, written
last: a change that fails halfway is not seen and writes the same segments when it is repeated, and
whoever reads an earlier version goes on reading it until :meth:`ReleaseStore.vacuum`. One job at a time
may write.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .index import ENTRY, fold_entries
from .releases import position
from .staging import drop_folder, join_side, run_folder, stage

#: Positions of a part of the evidence, parts of the index, and segments that a part may gather.
SPAN, BUCKETS, SEGMENTS = 1_000_000, 64, 8

EVIDENCE, POSTINGS, GONE, INDEX = TABLES = "evidence", "postings", "gone", "index"
_FOLD = ["lookup", *ENTRY]
_MANIFEST = "table string, part bigint, segment bigint, delta bigint, schema string"

Parts = dict[int, tuple[int, ...]]


@dataclass(frozen=True)
class Snapshot:
    """One version of a store. ``parts`` holds, by table and part, the segments it consists of."""

    store: ReleaseStore
    version: int = 0
    delta: int | None = None
    schema: T.StructType | None = None
    parts: dict[str, Parts] = field(default_factory=lambda: {t: {} for t in TABLES})

    def index(self) -> DataFrame:
        """The folded entries of all lookups, as ``plans.answer.build_index`` makes them."""
        return self.read(INDEX)

    def releases(self, at: DataFrame | None = None) -> DataFrame:
        """The releases; with ``at``, which has ``pos``, those of the ranges that its positions lie in."""
        return self.read(EVIDENCE, None if at is None else self.store.ranges(at))

    def postings(self, parts: list[int] | None = None) -> DataFrame:
        """The entries of the releases that the store holds."""
        found = self.read(POSTINGS, parts, "segment")
        if self.parts[GONE]:
            gone = self.read(GONE, None, "segment").groupBy("pos").agg(F.max("segment").alias("_until"))
            gone = join_side(stage(gone.withColumnRenamed("pos", "_gone"), "gone"))
            dead = (position(F.col("order")) == F.col("_gone")) & (F.col("segment") < F.col("_until"))
            found = found.join(gone, dead, "left_anti")
        return found.drop("segment")

    def read(self, table: str, parts: list[int] | None = None, *more: str) -> DataFrame:
        """Some parts of a table; ``more`` may be ``segment``, the change that wrote a row."""
        spark, root = self.store.spark, f"{self.store.path}/{table}"
        known = self.parts[table]
        chosen = known if parts is None else {p: known[p] for p in parts if p in known}
        paths = [f"{root}/segment={s}/part={p}" for p, segments in sorted(chosen.items()) for s in segments]
        schema = self.store.schema_of(table, self.schema)
        if not paths:
            return spark.createDataFrame([], T.StructType(schema.fields + [T.StructField(c, T.LongType()) for c in more]))
        found = spark.read.schema(schema).option("basePath", root).parquet(*paths)
        return found.select(*schema.names, *[F.col(c).cast("bigint") for c in more])


class ReleaseStore:
    """``entries`` makes the entries ``(lookup, key, rule, date, order)`` of releases; it has to be the
    same whenever the store is opened, and to look at one release at a time."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        entries: Callable[[DataFrame], DataFrame],
        span: int = SPAN,
        buckets: int = BUCKETS,
        segments: int = SEGMENTS,
    ):
        self.spark, self.path, self.entries = spark, path.rstrip("/"), entries
        self.span, self.buckets, self.segments = span, buckets, segments

    # -- versions ------------------------------------------------------------------------

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, name: str, committed: bool = False) -> list[int]:
        """The numbers of the subfolders ``name=number``; ``committed`` ones were written to the end."""
        path, files = self._files(folder)
        if not files.exists(path):
            return []
        found = [status.getPath() for status in files.listStatus(path)]
        found = [p for p in found if p.getName().startswith(f"{name}=")]
        if committed:
            done = self.spark._jvm.org.apache.hadoop.fs.Path
            found = [p for p in found if files.exists(done(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in found)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or one that is still there."""
        known = self._numbers(f"{self.path}/manifest", "version", committed=True)
        if not known:
            return Snapshot(self)
        version = known[-1] if version is None else version
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()
        parts: dict[str, Parts] = {t: {} for t in TABLES}
        delta = schema = None
        for row in rows:  # a row for each part, not for each release
            if row["table"]:
                own = parts[row["table"]]
                own[row["part"]] = (*own.get(row["part"], ()), row["segment"])
            else:
                delta, schema = row["delta"], T.StructType.fromJson(json.loads(row["schema"]))
        return Snapshot(self, version, delta, schema, {t: {p: tuple(sorted(s)) for p, s in own.items()} for t, own in parts.items()})

    def _commit(self, snapshot: Snapshot) -> Snapshot:
        rows = [(t, p, s, None, None) for t, own in snapshot.parts.items() for p, segments in own.items() for s in segments]
        rows.append(("", None, None, snapshot.delta, snapshot.schema.json()))
        frame = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/manifest/version={snapshot.version}")
        return snapshot

    def vacuum(self, keep: int = 2) -> None:
        """Delete what the ``keep`` newest versions do not name."""
        versions = self._numbers(f"{self.path}/manifest", "version", committed=True)
        kept = [self.snapshot(v) for v in versions[-keep:]]
        for table in TABLES:
            named = {(s, p) for one in kept for p, segments in one.parts[table].items() for s in segments}
            for segment in self._numbers(f"{self.path}/{table}", "segment"):
                if kept and segment > kept[-1].version:
                    continue  # being written
                for part in self._numbers(f"{self.path}/{table}/segment={segment}", "part"):
                    if (segment, part) not in named:
                        drop_folder(self.spark, f"{self.path}/{table}/segment={segment}/part={part}")
        for version in versions[:-keep]:
            drop_folder(self.spark, f"{self.path}/manifest/version={version}")

    # -- parts ---------------------------------------------------------------------------

    def schema_of(self, table: str, releases: T.StructType | None) -> T.StructType:
        if table == EVIDENCE:
            if releases is None:
                raise ValueError("the store holds nothing yet")
            return releases
        entry = "lookup string, key string, rule int, date string, order decimal(38,0)"
        kinds = {POSTINGS: entry, GONE: "pos bigint", INDEX: f"{entry}, n bigint"}
        return T.StructType.fromDDL(kinds[table])

    def _range(self) -> Column:
        return F.floor(F.col("pos") / self.span).cast("bigint")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("bigint")

    def ranges(self, at: DataFrame) -> list[int]:
        """The evidence parts of some positions: at most as many as the store has parts."""
        found = at.where(F.col("pos").isNotNull()).select(self._range().alias("part")).distinct()
        return [row["part"] for row in found.collect()]

    def _write(self, table: str, segment: int, rows: DataFrame, part: Column, known: Parts, anew: set[int]) -> Parts:
        """Writes a segment of all parts of ``rows`` and returns the table's parts, of which those in
        ``anew`` consist of just that segment."""
        folder = f"{self.path}/{table}/segment={segment}"
        rows = rows.withColumn("part", part).hint("rebalance", F.col("part"))  # a part with a hot key is split
        rows.write.mode("overwrite").partitionBy("part").parquet(folder)
        written = self._numbers(folder, "part")
        now = {p: segments for p, segments in known.items() if p not in anew}
        return now | {p: (*now.get(p, ()), segment) for p in written}

    def _full(self, known: Parts, touched: set[int]) -> set[int]:
        """Parts that have gathered too many segments to get another."""
        return {p for p in touched if len(known.get(p, ())) >= self.segments}

    # -- changes -------------------------------------------------------------------------

    def apply(
        self,
        changed: DataFrame | None = None,
        removed: DataFrame | None = None,
        delta: int | None = None,
        sequence: str | None = None,
    ) -> Snapshot:
        """Take up ``changed``, releases that are new or replace the one at their position, and drop
        those at the positions (``pos``) of ``removed`` that ``changed`` does not bring back.

        Of rows of ``changed`` that share a position the one with the greatest ``sequence`` counts, any
        one without; the column is not kept unless releases have it. Positions that hold nothing
        may be removed. ``delta`` numbers the change: one that is not above the last number has been
        applied before and does nothing, so a stream may repeat it. Rows without a position are left
        out. The first change sets the columns; further ones of later changes are dropped, missing
        ones are null.
        """
        before = self.snapshot()
        if delta is not None and before.delta is not None and delta <= before.delta:
            return before
        with run_folder(self.spark, "store-change") as folder:
            after = self._applied(before, changed, removed, delta, sequence)
        self._commit(after)
        drop_folder(self.spark, folder)
        return after

    def _fitted(self, changed: DataFrame | None, schema: T.StructType | None, sequence: str | None) -> DataFrame:
        if changed is None:
            return self.spark.createDataFrame([], schema)
        if schema is None:
            schema = T.StructType([f for f in changed.schema.fields if f.name != sequence])
        columns = [
            (F.col(f"`{f.name}`") if f.name in changed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
        ]
        rows = changed.where(F.col("pos").isNotNull())
        if sequence is None:
            return rows.select(*columns)
        last = rows.groupBy("pos").agg(F.max(F.col(sequence)).alias("_last"))
        rows = rows.join(last, "pos").where(F.col(sequence).eqNullSafe(F.col("_last")))
        return rows.select(*columns)

    def _once(self, rows: DataFrame) -> DataFrame:
        """Staged rows, one of each position. Just those of positions that come again are sorted and
        folded with their texts; the others stay as they were staged."""
        again = rows.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("pos")
        again = stage(again, "repeated")
        if again.isEmpty():
            return rows
        again = join_side(again)
        folded = rows.join(again, "pos", "left_semi").dropDuplicates(["pos"])
        return stage(rows.join(again, "pos", "left_anti").unionByName(folded), "added-once")

    def _applied(self, before: Snapshot, changed, removed, delta, sequence) -> Snapshot:
        if before.schema is None and changed is None:
            raise ValueError("the first change has to bring releases")
        added = self._once(stage(self._fitted(changed, before.schema, sequence), "added"))
        schema, segment = before.schema or added.schema, before.version + 1
        before = Snapshot(self, before.version, before.delta, schema, before.parts)
        positions = added.select("pos")
        if removed is not None:
            positions = positions.union(removed.select(F.col("pos").cast("bigint")).where(F.col("pos").isNotNull())).distinct()
        positions = stage(positions, "positions")
        touched = set(self.ranges(positions))
        held = sorted(touched & before.parts[EVIDENCE].keys())
        gone, left = None, set()
        if held:
            gone = stage(before.read(EVIDENCE, held).join(join_side(positions), "pos", "left_semi"), "gone")
            left = set(self.ranges(gone))
        rewritten = left | self._full(before.parts[EVIDENCE], touched)
        rows = added
        if rewritten:
            stays = before.read(EVIDENCE, sorted(rewritten)).join(join_side(positions), "pos", "left_anti")
            rows = stays.select(*schema.names).unionByName(added)
        evidence = self._write(EVIDENCE, segment, rows, self._range(), before.parts[EVIDENCE], rewritten)
        after = Snapshot(self, segment, delta if delta is not None else before.delta, schema)
        after = replace(after, parts={**before.parts, EVIDENCE: evidence})
        return self._entries_applied(before, after, added, gone if left else None)

    def _entries_applied(self, before: Snapshot, after: Snapshot, added: DataFrame, gone: DataFrame | None) -> Snapshot:
        """Postings and index after a change; ``gone`` are releases as they were, None for none."""
        segment = after.version

        def now(table: str, rows: DataFrame, part: Column, anew: set[int]) -> Snapshot:
            return replace(after, parts={**after.parts, table: self._write(table, segment, rows, part, before.parts[table], anew)})

        columns = self.schema_of(POSTINGS, None).names
        plus = stage(self.entries(added).withColumn("part", self._bucket()), "plus")
        touched = {row["part"] for row in plus.select("part").distinct().collect()}
        if gone is not None:
            after = now(GONE, gone.select("pos"), self._range(), set())
            minus = self.entries(gone).groupBy(*_FOLD).agg(F.min("order").alias("gone_order"), F.count(F.lit(1)).alias("gone_n"))
            minus = stage(minus.withColumn("part", self._bucket()), "minus")
            touched |= {row["part"] for row in minus.select("part").distinct().collect()}
        rewritten = self._full(before.parts[POSTINGS], touched)
        rows = plus.select(*columns)
        if rewritten:
            known = replace(after, parts={**after.parts, POSTINGS: before.parts[POSTINGS]})
            rows = rows.unionByName(known.postings(sorted(rewritten)).select(*columns))
        after = now(POSTINGS, rows, self._bucket(), rewritten)

        merged, more = before.read(INDEX, sorted(touched)), fold_entries(plus, "lookup")
        totals = [F.min("order").alias("order"), F.sum("n").alias("n")]
        if gone is None:
            merged = merged.unionByName(more).groupBy(*_FOLD).agg(*totals)
        else:
            less = merged.join(join_side(minus.drop("part")), _FOLD, "left")
            less = stage(less.withColumn("best_goes", F.coalesce(F.col("gone_order") <= F.col("order"), F.lit(False))), "less")
            hit = stage(less.where("best_goes").select(*_FOLD), "hit")
            parts = sorted(row["part"] for row in hit.select(self._bucket().alias("part")).distinct().collect())
            hit = join_side(hit)
            again = fold_entries(after.postings(parts).join(hit, _FOLD, "left_semi"), "lookup")
            less = less.where(~F.col("best_goes")).withColumn("n", F.col("n") - F.coalesce("gone_n", F.lit(0)))
            more = more.join(hit, _FOLD, "left_anti")
            merged = less.select(*merged.columns).unionByName(more).groupBy(*_FOLD).agg(*totals)
            merged = merged.unionByName(again.select(*_FOLD, "order", "n"))
        return now(INDEX, merged, self._bucket(), touched)

    def compact(self) -> Snapshot:
        """A version of the same rows whose postings hold what counts alone, a segment for each part."""
        before = self.snapshot()
        if before.schema is None:
            return before
        with run_folder(self.spark, "store-compaction") as folder:
            segment = before.version + 1
            anew = set(before.parts[POSTINGS])
            postings = self._write(POSTINGS, segment, before.postings(), self._bucket(), before.parts[POSTINGS], anew)
        after = replace(before, version=segment, parts={**before.parts, POSTINGS: postings, GONE: {}})
        self._commit(after)
        drop_folder(self.spark, folder)
        return after
