"""Document fingerprints: SimHash over weighted terms, and a search within a Hamming radius.

Terms are pairs of neighbouring words in lower case, each with weight 1 + ln(times it occurs).
The 64-bit hash of a term votes on each bit with its weight, plus for a set bit and minus for a
clear one; a fingerprint bit is set where the sum is positive.

The search keeps the fingerprints in permuted block tables. With ``blocks`` blocks and a radius
of r, two fingerprints within r differ in at most r blocks, so in some choice of ``blocks - r``
blocks they agree. There is a table for every choice, keyed by the agreeing blocks; a key
holds ``64 (blocks - r) / blocks`` bits, and candidates are verified by their full distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.operators.staging import stage

from .batches import SLICE, map_rows

BITS = 64
#: Mixes a word's hash into the pair it begins; odd, so no bits are lost.
PAIR = np.uint64(0x9E3779B97F4A7C15)


def term_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every pair of neighbouring words; of the word when there is but one."""
    word = xxhash.xxh64_intdigest
    words = np.array([word(w) for w in text.lower().encode().split()], dtype=np.uint64)
    if len(words) < 2:
        return words
    mixed = (words[:-1] * PAIR) ^ (words[1:] + (words[:-1] >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * PAIR
    return mixed ^ (mixed >> np.uint64(29))


def fingerprint(text: str) -> int:
    """SimHash of a text; zero when it has no word."""
    hashes = term_hashes(text)
    if not len(hashes):
        return 0
    terms, times = np.unique(hashes, return_counts=True)
    weights = (1.0 + np.log(times)).astype(np.float32)
    bits = np.unpackbits(terms.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for_bit = weights @ bits.astype(np.float32)
    return int(np.packbits(2 * for_bit > weights.sum(), bitorder="little").view("<u8")[0])


def likeness(a: int, b: int) -> float:
    """Share of equal bits, 0 to 1."""
    return 1.0 - (a ^ b).bit_count() / BITS


def as_hex(value: int) -> str:
    return f"{value:016x}"


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)``, 16 lower-case hex digits, one row per input row. A null text
    counts as empty; a text without a word has fingerprint zero."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))

    def make():
        return lambda rows: {"fingerprint": [as_hex(fingerprint(t)) for t in rows["text"]]}

    return map_rows(rows, ["doc_id"], ["text"], "fingerprint string", make)


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) gives way to as much of the beginning of the next text."""
    size = len(text) // 4
    return text[: len(text) - size] + following[:size]


def _judge(text: str, own: int, following: str, other: int) -> dict:
    changed = edited(text, following)
    mark = own if changed == text else fingerprint(changed)
    return {
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": as_hex(own),
        "edited_fingerprint": as_hex(mark),
        "near_edited": likeness(own, mark),
        "near_next": likeness(own, other),
    }


_JUDGED = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_EDGE = "part int, head_id {0}, head_text string, tail_id {0}, tail_text string"


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``: each text against its edited form and against the next document's text.

    Next is by ascending id, then text (null ids come first); the last row is followed by the
    first. A single row follows itself. Null texts count as empty. An empty table gives none.

    The texts are sorted once, into ranges. A task streams through its range holding one row
    and hands on the text of its first and last row; the few open ends, two rows for each
    range, are joined in a second step.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"doc_id {kind}, {_JUDGED}, edge struct<{_EDGE.format(kind).replace(', ', ',').replace(' ', ':')}>"
    out = to_arrow_schema(T.StructType.fromDDL(schema))
    names = [f.split()[0] for f in _JUDGED.split(", ")]

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = last = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = []
                for row_id, row_text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    row = (row_id, row_text, fingerprint(row_text))
                    if last is None:
                        head = row
                    else:
                        made.append({"doc_id": last[0], **_judge(*last[1:], *row[1:])})
                    last = row
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=out)
        if last is not None:
            edge = {
                "part": TaskContext.get().partitionId(),
                "head_id": head[0], "head_text": head[1], "tail_id": last[0], "tail_text": last[1],
            }
            yield pa.RecordBatch.from_pylist([{"edge": edge}], schema=out)

    sorted_rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    staged = stage(sorted_rows.mapInArrow(stream, schema), "fingerprints")
    edges = staged.where(F.col("edge").isNotNull()).select("edge.*")
    order = W.orderBy(F.col("head_id").asc_nulls_first())
    following = edges.select(
        "part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next_part")
    )
    heads = edges.select(F.col("part").alias("next_part"), "head_text")
    ends = (
        edges.select("part", F.col("tail_id").alias("doc_id"), F.col("tail_text").alias("text"))
        .join(following, "part")
        .join(heads, "next_part")
        .select("doc_id", "text", "head_text")
    )

    def make():
        def work(rows):
            made = [
                _judge(t, fingerprint(t), h, fingerprint(h)) for t, h in zip(rows["text"], rows["head_text"])
            ]
            return {n: [m[n] for m in made] for n in names}

        return work

    closed = map_rows(ends, ["doc_id"], ["text", "head_text"], _JUDGED, make)
    return staged.where(F.col("edge").isNull()).select("doc_id", *names).unionByName(closed)


def bits_of(hex_digits: Column) -> Column:
    """A fingerprint's bits as a signed long."""
    half = [F.conv(F.substring(hex_digits, at, 8), 16, 10).cast("bigint") for at in (1, 9)]
    return F.shiftleft(half[0], 32).bitwiseOR(half[1])


def block_masks(radius: int, blocks: int) -> list[int]:
    """For each table, a mask of the blocks that have to agree."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("blocks must be more than the radius and at most 64")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(block, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _tables(marks: Column, masks: list[int]) -> Column:
    """One key for each table: its number and the agreeing bits."""
    return F.array(
        *[
            F.struct(F.lit(n).cast("int").alias("table"), marks.bitwiseAND(F.lit(_signed(m))).alias("key"))
            for n, m in enumerate(masks)
        ]
    )


def within_radius(
    index: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 5, fingerprint: str = "fingerprint"
) -> DataFrame:
    """``(fingerprint, match, distance)``: for each distinct fingerprint of ``queries`` all
    distinct fingerprints of ``index`` at most ``radius`` bits away, itself included. Nulls
    match nothing.

    ``comb(blocks, radius)`` narrow rows per distinct fingerprint are shuffled. More blocks
    make longer keys and more tables. A pair that agrees in several tables counts in the first.
    """
    masks = block_masks(radius, blocks)

    def side(frame: DataFrame, name: str) -> DataFrame:
        once = frame.select(F.col(fingerprint).alias("hex")).where(F.col("hex").isNotNull()).distinct()
        marked = once.select(bits_of(F.col("hex")).alias(name))
        return marked.select(name, F.inline(_tables(F.col(name), masks)))

    different = F.col("_query").bitwiseXOR(F.col("_match"))
    agreeing = [
        F.when(different.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(n)) for n, m in enumerate(masks)
    ]
    found = (
        side(index, "_match")
        .hint("merge")  # generated rows look fewer than they are
        .join(side(queries, "_query"), ["table", "key"])
        .withColumn("distance", F.bit_count(different))
        .where((F.col("distance") <= radius) & (F.col("table") == F.coalesce(*agreeing)))
    )
    return found.select(
        F.lower(F.lpad(F.hex("_query"), 16, "0")).alias("fingerprint"),
        F.lower(F.lpad(F.hex("_match"), 16, "0")).alias("match"),
        "distance",
    )
