"""Mixing sources to target weights, in blocks of a fixed number of words.

The words of a source form one stream, cut into blocks. A source's target says how many blocks
the mix takes: whole passes over all its blocks and part of one more. Each such slot draws its
output shard by a hash, so that the counts of a shard are a multinomial draw, conditioned on the
totals that meet the targets. Slots are mapped to blocks through a pseudorandom permutation of
the source's block numbers, another one for each pass, and joined to blocks by that number. The
permutation is a swap-or-not shuffle: in each of some rounds, a number x and its mirror image
(key - x) mod n change places or not, by a bit hashed from the larger of the two. It needs no
table, and works for any n.

Everything is built-in functions. No window and no generated sequence grows with a source: the
places of texts in the stream are running sums within buckets on top of running sums over
buckets, and slots are generated in chunks that are dealt out first. Joins with slots ask for a merge,
since the optimizer takes generated rows for as few as they come from and would broadcast them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it.
WORD_AND_GAP = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Texts of a bucket of the stream, and slots of a generated chunk, about.
BUCKET, CHUNK = 4096, 65_536
#: Rounds of the shuffle that permutes block numbers, and primes that numbers are hashed with.
ROUNDS, P, Q, R = 24, 2147483647, 1000003, 998244353


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(rank, source, source_size, target, rows)`` from rows with ``source`` and ``size``.

    Sources in code point order, null last, take the weights in turn and share ``share`` times
    all words. A target stops at ``most`` times its source; the rest goes to the others by
    weight. The level that this settles on is the largest of the levels reached when sources are
    filled up one after another, in the order in which they fill. One row per source is handled
    in one task; nothing else is.
    """
    if most < share:
        raise ValueError("the sources cannot hold the share")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranked = totals.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    everything = W.partitionBy()
    filling = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    left = F.lit(share) * F.sum("source_size").over(everything) - (F.sum("cap").over(filling) - F.col("cap"))
    open_weight = F.sum("weight").over(everything) - (F.sum("weight").over(filling) - F.col("weight"))
    levels = ranked.withColumn("level", left / open_weight)
    target = F.least("cap", F.max("level").over(everything) * F.col("weight"))
    return levels.select("rank", "source", "source_size", target.alias("target"), "rows")


def _hashed(number: Column) -> Column:
    """A number below ``R`` from one below 2**46; the same in SQL."""
    mixed = (number % P * 48271 + 11) % P
    return (mixed * mixed + 2718281) % P % R


def _round_keys(n: Column, rank: Column, turn: int) -> Column:
    """``(key, seed)`` of each round, for a source and a pass; ``key`` is below n."""
    def of(r: Column) -> Column:
        base = rank * Q + turn * 10007 + r * 101
        seed = _hashed(base + 17)
        return F.struct(((seed * R + _hashed(base + 59)) % n).alias("key"), seed.alias("seed"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(ROUNDS - 1).cast("bigint")), of)


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """Number of a block: a permutation of 0 .. n-1 for each list of round keys."""
    def swapped(x: Column, r: Column) -> Column:
        other = (r["key"] - x + n) % n
        chosen = F.shiftright(_hashed(F.greatest(x, other) + r["seed"]), 10) % 2 == 1
        return F.when(chosen, other).otherwise(x)

    return F.aggregate(keys, index, swapped)


class Mix:
    """The parts of a mix, each a table. ``rows`` must have ``row``, ``doc_id``, ``source`` and
    ``size``."""

    def __init__(self, rows: DataFrame, block: int, shards: int, weights=WEIGHTS, share: float = 1.5, most: float = 2.0):
        self.block, self.turns = block, math.ceil(most) + 1
        targets = stage(source_targets(rows, weights, share, most), "targets")
        words = F.col("source_size")
        passes = F.when(words > 0, F.floor(F.col("target") / words)).otherwise(0).cast("bigint")
        rest = F.col("target") - F.col("passes") * words
        self.targets = (
            targets.withColumn("n_blocks", F.ceil(words / F.lit(block)).cast("bigint"))
            .withColumn("passes", passes)
            .withColumn("n_slots", F.col("passes") * F.col("n_blocks") + F.least(F.round(rest / block), "n_blocks").cast("bigint"))
        )
        self.placed = self._place(rows, targets)
        self.slots = self._slots(shards)

    def _place(self, rows: DataFrame, targets: DataFrame) -> DataFrame:
        """``(row, doc_id, rank, size, start)``: where each text begins in its source's stream.
        The order within a source is by bucket, then id, then size. Texts equal in all three are
        numbered where they were read, so a crowd of them is a row for each task in the window."""
        known = targets.select(
            F.col("source").alias("_source"), "rank", F.greatest(F.lit(1), F.expr(f"rows div {BUCKET}")).alias("buckets")
        )
        spread = _hashed(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(P)) * 48271 % P + F.col("size") * 40503) % F.col("buckets")
        rows = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("bucket", spread)
        rows = rows.withColumn("part", F.shiftright("row", 33))  # the task that numbered it
        same = ["rank", "bucket", "size", "part"]
        chunks = rows.groupBy(*same, F.col("doc_id").alias("_id")).agg((F.count(F.lit(1)) * F.col("size")).alias("words"))
        sums = chunks.groupBy("rank", "bucket").agg(F.sum("words").alias("words"))
        before = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        bases = sums.select("rank", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        within = W.partitionBy("rank", "bucket").orderBy("_id", "size", "part").rowsBetween(W.unboundedPreceding, -1)
        chunks = chunks.withColumn("inside", F.coalesce(F.sum("words").over(within), F.lit(0))).join(bases, ["rank", "bucket"])
        chunks = chunks.select(*same, "_id", (F.col("base") + F.col("inside")).alias("begin"))
        nth = F.row_number().over(W.partitionBy(*same, "doc_id").orderBy("row")) - 1
        match = F.col("doc_id").eqNullSafe(F.col("_id"))
        for c in same:
            chunks = chunks.withColumnRenamed(c, f"_{c}")
            match = match & (F.col(c) == F.col(f"_{c}"))
        placed = rows.withColumn("nth", nth).join(chunks, match)
        return placed.select("row", "doc_id", "rank", "size", (F.col("begin") + F.col("nth") * F.col("size")).alias("start"))

    def pieces(self) -> DataFrame:
        """``(rank, block, row, doc_id, size, first, words)``: what each text gives to each block."""
        first, last = F.col("start"), F.col("start") + F.col("size")
        at = F.explode(F.sequence(F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}")))
        cut = self.placed.where(F.col("size") > 0).select("rank", "row", "doc_id", "size", "start", at.alias("block"))
        begin = F.greatest(first, F.col("block") * self.block)
        end = F.least(last, (F.col("block") + 1) * self.block)
        return cut.select(
            "rank", "block", "row", "doc_id", "size", (begin - first).alias("first"), (end - begin).alias("words")
        )

    def _slots(self, shards: int) -> DataFrame:
        """``(rank, slot, pass, block, shard)``, one row for each block that the mix takes."""
        some = self.targets.where(F.col("n_slots") > 0)
        chunks = some.select(
            "rank", "n_blocks", "n_slots", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_slots - 1) div {CHUNK}"))).alias("chunk")
        ).repartition(int(some.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "chunk")
        begin = F.col("chunk") * CHUNK
        end = F.least(begin + CHUNK, F.col("n_slots")) - 1
        n = F.col("n_blocks")
        turns = F.array(*[_round_keys(n, F.col("rank"), turn) for turn in range(self.turns)])

        def placed(slot: Column) -> Column:
            turn = F.floor(slot / n)
            number = permuted(slot - turn * n, n, F.get("turns", turn.cast("int")))
            return F.struct(slot.alias("slot"), turn.alias("pass"), number.alias("block"))

        slots = chunks.withColumn("turns", turns).select("rank", F.inline(F.transform(F.sequence(begin, end), placed)))
        shard = F.pmod(F.xxhash64("rank", "slot"), F.lit(shards))
        return slots.select("rank", "slot", "pass", "block", shard.alias("shard"))

    def shard_counts(self) -> DataFrame:
        """``(shard, rank, n)``: the blocks of each source in each output shard."""
        return self.slots.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n"))

    def blocks(self) -> DataFrame:
        """``(shard, rank, slot, pass, block, row, doc_id, size, first, words)``: the mixed blocks,
        as the pieces of texts they are made of."""
        return self.slots.hint("merge").join(self.pieces(), ["rank", "block"])

    def taken(self) -> DataFrame:
        """``(row, taken)`` of texts that the mix takes words from."""
        times = self.slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
        used = self.pieces().join(times.hint("merge"), ["rank", "block"])
        return used.groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number each, to be written down at once so that it stays."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def mix_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block: int = 64,
    shards: int = 64,
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per input row.

    A source's words come to its target but for less than two blocks. No text is taken more than
    twice. Null texts have size 0, null sources are one source, and rows that repeat an id are
    texts of their own. An empty table gives none.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    rows = stage(_numbered(rows), "sizes")
    mix = Mix(rows, block, shards)
    known = mix.targets.select("rank", "source_size", "target")
    return (
        mix.placed.join(mix.taken(), "row", "left")
        .join(known, "rank")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )


def mixed_texts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block: int = 64,
    shards: int = 64,
) -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs``: a row for each pass that
    takes words of a document, its text being just those words with the white space before them.
    A pass that takes all of a text leaves it as it is. Texts without words are never taken.
    """
    rows = stage(
        docs.select(F.struct("*").alias("doc"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"),
                    n_words(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("row")),
        "mixed-rows",
    )
    mix = Mix(rows.select("row", "doc_id", "source", "size"), block, shards)
    span = F.struct(F.col("first").cast("int").alias("first"), F.col("words").cast("int").alias("words"))
    spans = mix.blocks().groupBy("row", "pass").agg(F.sort_array(F.collect_list(span)).alias("spans"), F.sum("words").alias("given"))
    whole = F.col(f"doc.`{text}`")
    words = F.regexp_extract_all(whole, F.lit(WORD_AND_GAP), F.lit(0))
    part = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(F.col("_words"), s["first"] + 1, s["words"]))), "")
    taken = rows.select("row", "doc", "size").join(spans, "row")
    taken = taken.withColumn("_words", F.when(F.col("given") < F.col("size"), words))
    taken = taken.withColumn("_text", F.when(F.col("given") < F.col("size"), part).otherwise(whole))
    return taken.select(*[F.col("_text").alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns])
