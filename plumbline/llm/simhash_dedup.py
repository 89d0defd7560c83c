"""Near duplicates by SimHash, candidates filtered by the pigeonring principle.

The 64 bits form a ring of ``segments`` equal segments. When two fingerprints differ in at most
``radius`` bits, some segment begins a chain in which, for every length l, the first l segments
differ in at most l * radius / segments bits together. With more segments than the radius the
first segment of the chain is equal, so the first two make a key: the first as it is, the second
in every form its budget allows. That is an equi-join on half a fingerprint. Longer chains are
checked next, then the whole distance.

A key that crowds would pair all its members. Crowded keys are counted, and their members linked
without pairs: two fingerprints at most two bits apart share a neighbour one bit away, so each is
linked to the least member around every such neighbour. What that leaves apart within a crowded
key can only touch fingerprints outside the key's largest group; those, and only those, look
through all neighbours two bits away for a member one bit further. Links are as complete as by
pairs, and the work for one fingerprint is bounded whatever the crowd.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators.staging import stage

from .batches import map_rows
from .components import components

BITS = 64
SEED = 42
CROWD = 256


def simhash(text: str, shingle: int = 3) -> int:
    """A bit is set when it is set in over half of the shingle hashes (XXH64), repeats counted.
    Only A-Z are lowered; words end at ASCII white space. Zero without a word."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(words) - shingle) + 1
    span = zip(starts[:last].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in span], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])


def simhashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, mark)``, the fingerprint as a signed long, with the columns ``also`` before it.
    Null texts count as empty."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), *also)

    def make():
        def work(rows):
            marks = np.array([simhash(t, shingle) for t in rows["text"]], dtype=np.uint64)
            return {"mark": marks.view(np.int64)}

        return work

    return map_rows(rows, ["doc_id", *also], ["text"], "mark bigint", make)


# -- candidates ----------------------------------------------------------------------------


def _turned(mark: Column, by: int) -> Column:
    """The ring turned left, so that it begins ``by`` bits later."""
    if not by:
        return mark
    return F.shiftleft(mark, by).bitwiseOR(F.shiftrightunsigned(mark, BITS - by))


def _budget(length: int, radius: int, segments: int) -> int:
    return length * radius // segments


def _flips(width: int, most: int) -> list[int]:
    """Masks of up to ``most`` of ``width`` bits."""
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)]


def _keys(mark: Column, segments: int, flips: list[int]) -> Column:
    """``(chain, key)`` for every place a chain may begin and every form of its second segment."""
    width = BITS // segments
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("chain"),
                F.shiftrightunsigned(_turned(mark, i * width), BITS - 2 * width).bitwiseXOR(F.lit(f)).alias("key"),
            )
            for i in range(segments)
            for f in flips
        ]
    )


def _chain_holds(a: Column, b: Column, radius: int, segments: int) -> Column:
    """The budgets of chains of every length, from the segment the key names."""
    width, different = BITS // segments, a.bitwiseXOR(b)
    tests = []
    for chain in range(segments):
        ring = _turned(different, chain * width)
        held = [
            F.bit_count(F.shiftrightunsigned(ring, BITS - n * width)) <= _budget(n, radius, segments)
            for n in range(3, segments)
        ]
        tests.append((F.col("chain") != chain) | reduce(Column.__and__, held, F.lit(True)))
    return reduce(Column.__and__, tests) & (F.bit_count(different) <= radius)


def near_links(marks: DataFrame, radius: int = 3, segments: int = 4, crowd: int = CROWD) -> DataFrame:
    """``(a, b)`` links between distinct fingerprints (column ``mark``) at most ``radius`` bits
    apart: every such pair outside crowded keys, and in crowds enough links to join whatever
    such pairs join. ``crowd`` bounds the pairs a fingerprint makes for a key."""
    if BITS % segments or not radius < segments:
        raise ValueError("segments must divide 64 and be more than the radius")
    flips = _flips(BITS // segments, _budget(2, radius, segments))
    # Generated rows look fewer than they are: without the hint a side could be broadcast.
    own = marks.select("mark", F.inline(_keys(F.col("mark"), segments, [0])))
    probes = marks.select(F.col("mark").alias("a"), F.inline(_keys(F.col("mark"), segments, flips)))
    crowded = stage(
        own.groupBy("chain", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("chain", "key"),
        "crowded-keys",
    )
    by = ["chain", "key"]
    pairs = (
        probes.join(own.withColumnRenamed("mark", "b").hint("merge"), by)
        .where((F.col("a") < F.col("b")) & _chain_holds(F.col("a"), F.col("b"), radius, segments))
        .select("a", "b")
    )
    if crowded.isEmpty():
        return pairs
    if radius != 3:
        raise NotImplementedError("crowded keys are linked for a radius of three bits only")
    calm = (
        probes.join(crowded, by, "left_anti")
        .join(own.withColumnRenamed("mark", "b").join(crowded, by, "left_anti").hint("merge"), by)
        .where((F.col("a") < F.col("b")) & _chain_holds(F.col("a"), F.col("b"), radius, segments))
        .select("a", "b")
    )
    touching = stage(probes.join(crowded, by, "left_semi").withColumnRenamed("a", "mark"), "crowds")
    return calm.unionByName(_crowd_links(touching))


def _around(mark: Column, most: int) -> Column:
    """All values at most ``most`` bits away."""
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in _flips(BITS, most)]
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: mark.bitwiseXOR(m))


def _crowd_links(touching: DataFrame) -> DataFrame:
    """Links among fingerprints that touch crowded keys, ``(mark, chain, key)``."""
    members = stage(touching.select("mark").distinct(), "crowd-members")
    near = members.select("mark", F.explode(_around(F.col("mark"), 1)).alias("at"))
    least = F.min("mark").over(W.partitionBy("at"))  # at most 65 members lie one bit around a value
    close = near.select(least.alias("a"), F.col("mark").alias("b")).where(F.col("a") < F.col("b")).distinct()
    close = stage(close, "crowd-links")
    groups = components(close)
    grouped = (
        touching.join(groups, touching["mark"] == groups["node"], "left")
        .select("chain", "key", "mark", F.coalesce("root", "mark").alias("root"))
    )
    sizes = grouped.groupBy("chain", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("chain", "key").agg(F.max(F.struct("n", "root"))["root"].alias("largest"))
    apart = grouped.join(largest, ["chain", "key"]).where(F.col("root") != F.col("largest"))
    apart = stage(apart.select("mark").distinct(), "crowd-apart")
    wide = apart.select(F.col("mark").alias("b"), F.explode(_around(F.col("mark"), 2)).alias("at"))
    centres = near.groupBy("at").agg(F.min("mark").alias("a"))
    far = wide.hint("merge").join(centres, "at").where(F.col("a") != F.col("b")).select("a", "b").distinct()
    return close.unionByName(far)


# -- groups --------------------------------------------------------------------------------


def _groups(hashed: DataFrame, radius: int, segments: int, crowd: int) -> DataFrame:
    """``(mark, root, component_id, n_links)`` for every fingerprint; ``root`` is one fingerprint
    of its component."""
    marks = stage(hashed.groupBy("mark").agg(F.min("doc_id").alias("least_id")), "marks")
    links = stage(near_links(marks.select("mark"), radius, segments, crowd).distinct(), "links")
    roots = components(links).withColumnRenamed("node", "mark")
    ends = links.select(F.col("a").alias("mark")).union(links.select("b"))
    degrees = ends.groupBy("mark").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = marks.join(roots, "mark", "left").join(degrees, "mark", "left").select(
        "mark", "least_id", F.coalesce("root", "mark").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return stage(rooted.join(least, "root").select("mark", "root", "component_id", "n_links"), "mark-components")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    radius: int = 3,
    segments: int = 4,
    crowd: int = CROWD,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id, n_links)``, one row per input row.

    Documents link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is
    the smallest id reachable, itself included. ``n_links`` is true links found between the
    document's fingerprint and different ones (in crowds, the links kept to join it). Texts
    without a word have fingerprint zero, linked like any other. Null ids take part; a component
    with no other id has none. Repeated rows share a component. An empty table gives none.
    """
    hashed = stage(simhashes(docs, doc_id, text, shingle), "simhashes")
    known = _groups(hashed, radius, segments, crowd).drop("root")
    return hashed.join(known, "mark").select(
        "doc_id",
        F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"),
        "component_id",
        "n_links",
    )


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    radius: int = 3,
    segments: int = 4,
    crowd: int = CROWD,
) -> DataFrame:
    """One row of each component, with all its columns: one with the smallest id; of rows that
    repeat that id in the component any one. A row without an id stays only where no row of its
    component has one. Ids name no rows: what an id or a null does in one component says nothing
    about the same id, or other nulls, in another.
    """
    # Numbered and written down at once, so that a row keeps its number.
    rows = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    read = rows.select(F.col(f"doc.`{doc_id}`").alias("doc_id"), F.col(f"doc.`{text}`").alias("text"), "row")
    hashed = stage(simhashes(read, shingle=shingle, also=("row",)), "simhashes")
    known = _groups(hashed, radius, segments, crowd).select("mark", "root")
    # Folded by fingerprint first, map-side: a crowd of equal texts is one row in the join.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    leaders = hashed.groupBy("mark").agg(first.alias("first")).join(known, "mark")
    stays = leaders.groupBy("root").agg(F.min("first")["row"].alias("row")).select("row")
    kept = rows.join(stays.hint("merge"), "row", "left_semi")
    return kept.select(*[F.col(f"doc.`{c}`") for c in docs.columns])
