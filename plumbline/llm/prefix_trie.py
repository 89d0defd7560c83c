"""The prefix trie of conversations, built as double-array tries shard by shard.

A conversation is a sequence of turns, a turn being its role and text, known by 128 bits of their
hashes. Sequences are cut into segments of at most ``SEGMENT`` turns, so no conversation is too long
for a task. A prefix has a key: the exclusive or of its turns' hashes, each mixed with its position.
Keys can be summed up in any order, so every segment knows the key it starts from. Equal segments
that start alike are folded to one, map-side first, with the number of conversations they stand for.

Segments are dealt to shards by prefix: by their first turn where few enough turns share it, else by
two, four, ... turns. A task numbers the turns of a shard densely and packs BASE and CHECK: a state
``s`` and a turn ``c`` lead to ``t = BASE[s] + c`` if ``CHECK[t] == s``. Walking its segments through the
arrays gives the nodes and what their members add up to. Nodes above a shard's own prefix belong to
several shards; their aggregates are merged globally, the others are complete.

What a subtree adds up to comes from the same walk. A node is owned by its smallest member. For any
quantity of nodes, the sum over a subtree is the sum of what its members own, less what the owner of
its top owns above it. So a second walk, with what each conversation owns as its weight, gives leaves
and saved tokens without passing anything from level to level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.operators.staging import join_side, stage

#: Turns of a segment, of a prefix that one shard may hold, and of a trie built at a time.
SEGMENT, SHARD, CHUNK = 256, 100_000, 200_000
#: Free places tried for a branching node before it goes to the end of the arrays.
TRIES = 64
#: Bytes of the pieces that lists of ids are joined into.
PIECE = 1 << 20

_AT_BITS = (1 << 33) - 1
_NODE = ["depth", "k1", "k2"]


# -- turns in order --------------------------------------------------------------------------


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, pos, t1, t2, chars)``: the turns of each conversation numbered from 1.

    Turns are ordered by ``turn``, nulls first; ties by role, then by a hash of the text. Null roles
    and texts are empty ones, repeated rows are turns of their own, rows without a conversation are
    left out. Rows are sorted over all tasks and counted where a conversation crosses from one task
    to the next, so a conversation may have any number of turns.
    """
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        said[0].alias("role"),
        F.xxhash64(*said).alias("t1"),
        F.xxhash64(F.lit(1), *said).alias("t2"),
        F.char_length(said[1]).cast("bigint").alias("chars"),
        F.xxhash64(F.monotonically_increasing_id()).alias("row"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "t1", "t2", "row"]
    dealt = rows.repartitionByRange(_parts(turns), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(_AT_BITS))
    dealt = stage(dealt.select("conv_id", "t1", "t2", "chars", F.spark_partition_id().alias("part"), at.alias("at")), "turns")
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("base")
    bases = counts.select("conv_id", "part", base)
    placed = dealt.join(bases, ["conv_id", "part"])
    return stage(placed.select("conv_id", (F.col("base") + F.col("at")).alias("pos"), "t1", "t2", "chars"), "turns-in-order")


# -- keys ------------------------------------------------------------------------------------


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = numbers.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def turn_keys(t: np.ndarray, pos: np.ndarray, half: int) -> np.ndarray:
    """What each turn at its position gives to one half of a key."""
    places = _mixed(pos.astype(np.uint64) * np.uint64(2) + np.uint64(half))
    return _mixed(t.view(np.uint64) ^ places).view(np.int64)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for the elements of each list."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _segments(turns: DataFrame, size: int) -> DataFrame:
    """``(conv_id, band, s1, s2, e1, e2, t1, t2, chars, last)``: a segment, the keys of the prefixes before
    and with it, and whether the conversation ends with it."""
    turn = F.struct("pos", "t1", "t2", "chars")
    band = F.expr(f"(pos - 1) div {size}")
    cut = turns.groupBy("conv_id", band.alias("band")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    cut = cut.select("conv_id", "band", "turns.t1", "turns.t2", "turns.chars")
    kind = T.StructType([*cut.schema.fields, *T.StructType.fromDDL("x1 bigint, x2 bigint").fields])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for half, name in enumerate(("t1", "t2")):
                t, lengths = _lists(batch[name])
                pos = np.repeat(batch["band"].to_numpy(zero_copy_only=False) * size, lengths) + _within(lengths) + 1
                keys = turn_keys(np.ascontiguousarray(t), pos, half)
                found.append(pa.array(np.bitwise_xor.reduceat(keys, np.cumsum(lengths) - lengths)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=kind.names)

    along = W.partitionBy("conv_id").orderBy("band")  # a row for each segment
    before = along.rowsBetween(W.unboundedPreceding, -1)
    keyed = cut.mapInArrow(work, kind)
    keyed = keyed.withColumns({f"s{i}": F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0).cast("bigint")) for i in (1, 2)})
    keyed = keyed.withColumn("last", F.lead("band").over(along).isNull())
    ends = {f"e{i}": F.col(f"s{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}
    return stage(keyed.withColumns(ends).drop("x1", "x2"), "segments")


_FOLD = ["band", "e1", "e2", "last"]


def _folded(segments: DataFrame) -> DataFrame:
    """Equal segments after equal prefixes as one: ``n`` of them, ``conv`` the smallest."""
    same = ["s1", "s2", "t1", "t2", "chars"]
    return segments.groupBy(*_FOLD).agg(
        *[F.first(c).alias(c) for c in same], F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")
    )


def _dealt(folded: DataFrame, size: int, most: int) -> DataFrame:
    """Adds ``shard`` and ``own``: the number of turns, the fewest of 1, 2, 4, ... that not more than ``most``
    turns of segments share, and a hash of them. Only prefixes that are shared by more go on to the
    next round."""
    open_, settled, own = stage(folded, "folded"), None, 1
    while True:
        prefix = F.xxhash64("band", "s1", "s2", F.slice("t1", 1, own), F.slice("t2", 1, own))
        named = open_.withColumn("shard", prefix).withColumn("own", F.lit(own))
        if own >= size:
            return named if settled is None else settled.unionByName(named)
        loads = named.groupBy("shard").agg(F.sum(F.size("t1")).alias("load")).where(F.col("load") > most)
        hot = stage(loads.select("shard"), "shared-prefixes")
        if hot.isEmpty():
            return named if settled is None else settled.unionByName(named)
        hot = join_side(hot)
        fits = named.join(hot, "shard", "left_anti")
        settled = fits if settled is None else settled.unionByName(fits)
        open_ = stage(named.join(hot, "shard", "left_semi").drop("shard", "own"), "folded")
        own *= 2


# -- double arrays ---------------------------------------------------------------------------


class DoubleArray:
    """A trie over sequences of small numbers in two arrays. State 0 is the root."""

    def __init__(self):
        self.base = np.zeros(1024, dtype=np.int64)
        self.check = np.full(1024, -1, dtype=np.int64)
        self.check[0] = 0
        self.end = 1  # places from here on are free

    def _reach(self, end: int) -> None:
        if end > len(self.check):
            more = max(end, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, dtype=np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, dtype=np.int64)))
        self.end = max(self.end, end)

    def _branch(self, state: int, labels: np.ndarray, free: np.ndarray) -> None:
        """Places several children of a state at the first free places that fit them all."""
        starts = free[self.check[free] < 0][:TRIES] - labels[0]
        places = starts[:, None] + labels[None, :]
        fits = (self.check[np.minimum(places, len(self.check) - 1)] < 0) | (places >= self.end)
        fitting = np.nonzero(fits.all(axis=1))[0]
        base = int(starts[fitting[0]]) if len(fitting) else self.end - int(labels[0])
        self._reach(base + int(labels[-1]) + 1)
        self.base[state] = base
        self.check[base + labels] = state

    def add_level(self, states: np.ndarray, labels: np.ndarray) -> None:
        """Adds distinct children of states that have none yet; sorted by state, then label."""
        begins = np.nonzero(np.concatenate(([True], states[1:] != states[:-1])))[0]
        counts = np.diff(np.append(begins, len(states)))
        free = np.nonzero(self.check[: self.end] < 0)[0]
        for at, n in zip(begins[counts > 1].tolist(), counts[counts > 1].tolist()):
            self._branch(int(states[at]), labels[at : at + n], free)
        single = begins[counts == 1]
        free = free[self.check[free] < 0][: len(single)]
        lacking = len(single) - len(free)
        if lacking:
            free = np.concatenate((free, np.arange(self.end, self.end + lacking)))
            self._reach(self.end + lacking)
        self.base[states[single]] = free - labels[single]
        self.check[free] = states[single]

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The children of states by labels."""
        to = self.base[states] + labels
        if (self.check[to] != states).any():
            raise ValueError("the trie has no such sequence")
        return to


def pack(labels: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The trie of sequences, laid end to end in ``labels``, level by level."""
    trie = DoubleArray()
    begins = np.cumsum(lengths) - lengths
    states = np.zeros(len(lengths), dtype=np.int64)
    for depth in range(int(lengths.max(initial=0))):
        live = np.nonzero(lengths > depth)[0]
        at, label = states[live], labels[begins[live] + depth]
        order = np.lexsort((label, at))
        a, b = at[order], label[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        trie.add_level(a[new], b[new])
        states[live] = trie.step(at, label)
    return trie


def _nodes_of(table: pa.Table, size: int, sums: Sequence[str], names: Sequence[str]) -> pa.RecordBatch:
    """The nodes of some whole shards."""
    t1, lengths = _lists(table["t1"].combine_chunks())
    t2, chars = (np.ascontiguousarray(_lists(table[c].combine_chunks())[0]) for c in ("t2", "chars"))
    t1 = np.ascontiguousarray(t1)
    band, s1, s2, own, conv = (table[c].to_numpy() for c in ("band", "s1", "s2", "own", "conv"))
    pos = np.repeat(band * size, lengths) + _within(lengths) + 1
    order = np.lexsort((t2, t1))
    new = np.concatenate(([True], (t1[order][1:] != t1[order][:-1]) | (t2[order][1:] != t2[order][:-1])))
    dense = np.empty(len(t1), dtype=np.int64)
    dense[order] = np.cumsum(new) - 1
    # segments start at prefixes, which come first as labels of their own
    starts = np.unique(np.stack((band, s1, s2), axis=1), axis=0, return_inverse=True)[1].ravel()
    labels = np.insert(dense, np.cumsum(lengths) - lengths, starts + int(new.sum()))
    lengths = lengths + 1
    trie = pack(labels, lengths)

    begins = np.cumsum(lengths) - lengths
    z1, z2 = (turn_keys(t, pos, half) for half, t in enumerate((t1, t2)))
    values = {c: table[c].to_numpy() for c in sums}
    found = {c: np.zeros(trie.end, dtype=np.int64) for c in ["depth", "k1", "k2", "p1", "p2", "chars", "shared", *sums]}
    found["conv"] = np.full(trie.end, np.iinfo(np.int64).max)
    states = trie.step(np.zeros(len(lengths), dtype=np.int64), labels[begins])
    k1, k2 = s1.copy(), s2.copy()
    top = np.zeros(trie.end, dtype=bool)
    top[states] = True
    for depth in range(1, int(lengths.max(initial=0))):
        live = np.nonzero(lengths > depth)[0]
        turn = begins[live] + depth - live - 1  # among the turns, which lack the labels of the starts
        to = trie.step(states[live], labels[begins[live] + depth])
        found["p1"][to], found["p2"][to] = k1[live], k2[live]
        k1[live] ^= z1[turn]
        k2[live] ^= z2[turn]
        found["k1"][to], found["k2"][to] = k1[live], k2[live]
        found["depth"][to], found["chars"][to] = pos[turn], chars[turn]
        found["shared"][to] = depth < own[live]
        np.minimum.at(found["conv"], to, conv[live])
        for c in sums:
            np.add.at(found[c], to, values[c][live])
        states[live] = to
    nodes = np.nonzero((trie.check[: trie.end] >= 0) & ~top)[0][1:]  # without the root
    columns = [pa.array(found[c][nodes].astype(bool) if c == "shared" else found[c][nodes]) for c in names]
    return pa.RecordBatch.from_arrays(columns, names=list(names))


def _walk(dealt: DataFrame, size: int, sums: Sequence[str], chunk: int) -> DataFrame:
    """``(depth, k1, k2, p1, p2, chars, conv, *sums)`` of every node but the root. Shards are built as
    many at a time as hold ``chunk`` turns; a shard is never parted."""
    kind = T.StructType.fromDDL(
        "depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, chars bigint, conv bigint, shared boolean"
        + "".join(f", {c} bigint" for c in sums)
    )

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        turns = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            turns += int(batch["t1"].value_lengths().to_numpy(zero_copy_only=False).sum())
            if turns < chunk:
                continue
            table = pa.Table.from_batches(held)
            shard = table["shard"].to_numpy()
            whole = int(np.searchsorted(shard, shard[-1]))  # rows are sorted by shard; the last may go on
            if whole:
                yield _nodes_of(table.slice(0, whole), size, sums, kind.names)
                held = table.slice(whole).combine_chunks().to_batches()
                turns = sum(int(b["t1"].value_lengths().to_numpy(zero_copy_only=False).sum()) for b in held)
        if held:
            yield _nodes_of(pa.Table.from_batches(held), size, sums, kind.names)

    columns = ["shard", "own", "band", "s1", "s2", "t1", "t2", "chars", "conv", *sums]
    rows = dealt.select(*columns).repartition(_parts(dealt), "shard").sortWithinPartitions("shard")
    found = stage(rows.mapInArrow(work, kind), "shard-nodes")
    whole = ["depth", "k1", "k2", "p1", "p2", "chars"]
    shared = found.where("shared").groupBy(*whole).agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in sums])
    return found.where(~F.col("shared")).drop("shared").unionByName(shared)


# -- ids of those that end at a node -----------------------------------------------------------


def _digests(ends: DataFrame, key: Sequence[str], piece: int = PIECE) -> DataFrame:
    """``(*key, ends_sha256)`` of the ids at each key, ascending, in decimals, joined by commas.

    Ids are sorted over all tasks and joined into pieces there; what meets in one task for a key is
    a stream of pieces, hashed as they come. A hash reads its input in order, so that is one task.
    """
    order = [*key, "conv_id"]
    kind = T.StructType([*[ends.schema[c] for c in key], *T.StructType.fromDDL("first bigint, piece string").fields])
    sorted_ = ends.select(*order).repartitionByRange(_parts(ends), *order).sortWithinPartitions(*order)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, held, size = None, None, [], 0
        for batch in batches:
            rows = []
            for *k, conv in zip(*(column.to_pylist() for column in batch.columns)):
                if held and (k != at or size > piece):
                    rows.append((*at, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    at, first = k, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=kind.names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, first, ",".join(held))], names=kind.names)

    pieces = sorted_.mapInArrow(join, kind).repartition(_parts(ends), *key).sortWithinPartitions(*key, "first")
    told = T.StructType([*[ends.schema[c] for c in key], T.StructField("ends_sha256", T.StringType())])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running = None, None
        for batch in batches:
            rows = []
            for *k, _, text in zip(*(column.to_pylist() for column in batch.columns)):
                if k == at:
                    running.update(b"," + text.encode())
                    continue
                if at is not None:
                    rows.append((*at, running.hexdigest()))
                at, running = k, hashlib.sha256(text.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=told.names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, running.hexdigest())], names=told.names)

    return pieces.mapInArrow(digest, told)


# -- the whole trie ----------------------------------------------------------------------------


def _owned_above(nodes: DataFrame, size: int) -> Column:
    """The gain of the nodes that a node's owner owns above it: a running sum inside a band of
    depths on top of one over bands, so that no window is as long as a conversation."""
    inside = W.partitionBy("conv", "band").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    rows = nodes.withColumn("band", F.expr(f"depth div {size}")).withColumn("inside", F.coalesce(F.sum("gain").over(inside), F.lit(0)))
    sums = rows.groupBy("conv", "band").agg(F.sum("gain").alias("sum"))
    before = W.partitionBy("conv").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("conv", "band", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, ["conv", "band"]).withColumn("above", F.col("base") + F.col("inside")).drop("band", "base", "inside")


def prefix_trie(
    turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard: int = SHARD, chunk: int = CHUNK
) -> DataFrame:
    """The nodes of the trie: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, k1, k2)``, the root included.

    ``turns`` has ``conv_id, pos, t1, t2, chars`` as :func:`in_order` makes them, positions counting up from
    1; ``convs`` has every ``conv_id`` once, also of conversations without turns, which are members of
    the root alone. ``conv_id`` is the smallest member; ``n_leaves`` counts the childless nodes of the
    subtree, ``saved_tokens`` sums (members - 1) times the code points of the last text over it;
    ``ends_sha256`` is of the ids that end at the node. Without conversations there are no nodes.
    """
    segments = _segments(turns, segment)
    dealt = stage(_dealt(_folded(segments), segment, shard), "dealt")
    nodes = _walk(dealt, segment, ["n"], chunk)
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    every = convs.agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    zero = {c: F.lit(0).cast("bigint") for c in ("depth", "k1", "k2", "chars")}
    root = every.withColumns(zero | {c: F.lit(None).cast("bigint") for c in ("p1", "p2")})
    nodes = nodes.unionByName(root.select(*nodes.columns)).join(children, _NODE, "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    nodes = stage(nodes.withColumn("gain", (F.col("n") - 1) * F.col("chars")), "trie-nodes")

    own = nodes.groupBy(F.col("conv").alias("conv_id")).agg(
        F.sum("gain").alias("gain"), F.count_if(F.col("n_children") == 0).alias("leaves")
    )
    weights = segments.select("conv_id", *_FOLD).join(own, "conv_id").groupBy(*_FOLD)
    weights = weights.agg(F.sum("gain").alias("gain"), F.sum("leaves").alias("leaves"))
    none = {c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gain", "leaves")}
    weighted = dealt.join(weights, _FOLD, "left").select(*dealt.columns, *none.values())
    sums = _walk(weighted, segment, ["gain", "leaves"], chunk).select(
        *_NODE, F.col("gain").alias("members_gain"), F.col("leaves").alias("n_leaves")
    )
    total = nodes.agg(F.sum("gain").alias("members_gain"), F.count_if(F.col("n_children") == 0).alias("n_leaves"))
    at_root = total.select(*[zero[c].alias(c) for c in _NODE], "members_gain", "n_leaves")
    sums = sums.unionByName(at_root)

    ends = segments.where("last").select(
        (F.col("band") * segment + F.size("t1")).alias("depth"), F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv_id"
    )
    silent = convs.select("conv_id").join(segments.select("conv_id").where(F.col("band") == 0), "conv_id", "left_anti")
    ends = ends.unionByName(silent.select(*[zero[c].alias(c) for c in _NODE], "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    found = _owned_above(nodes, segment).join(sums, _NODE).join(_digests(ends, _NODE), _NODE, "left")
    found = found.hint("merge").join(parents.hint("merge"), ["depth", "p1", "p2"], "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return found.select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        (F.col("members_gain") - F.col("above")).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
        "k1",
        "k2",
    )
