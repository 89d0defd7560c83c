"""Exact duplicates, with frequent texts split off before the shuffle.

A frequent-items sketch (Misra-Gries counters, Spark's ``approx_top_k``) is merged map-side over
the digests of all texts. What it reports is counted exactly; the digests that really hold more
than one row in ``capacity`` are the winners. There are at most ``capacity`` of them, so they are
broadcast and their rows are settled where they are read. All other digests shuffle as usual,
and none of their groups is large.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbline.operators.staging import stage

CAPACITY = 1024


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. Null counts as empty. A text of
    one-byte characters holds no others, and ``lower`` is the faster way there."""
    whole = F.coalesce(text, F.lit(""))
    plain = F.octet_length(whole) == F.char_length(whole)
    exact = F.translate(whole, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(whole)).otherwise(exact)


def text_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, digest)`` of every row: lower-case hex SHA-256 of the normalised text."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.sha2(ascii_lower(F.col(text)), 256).alias("digest")
    )


def frequent_digests(digests: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(digest, keep_id, group_size)`` of digests with more than one row in ``capacity``.

    The sketch tracks four times as many counters as can win, so its error bound (under one row
    in ``capacity``) lets no winner slip; what it reports is verified by an exact count. A digest
    it missed would still be right, only shuffled.
    """
    sketch = digests.agg(
        F.expr(f"approx_top_k(digest, {capacity}, {4 * capacity})").alias("top"),
        F.count(F.lit(1)).alias("rows"),
    )
    reported = sketch.select(F.explode("top").alias("item"), "rows").select("item.item", "rows")
    counted = (
        digests.join(F.broadcast(reported), F.col("digest") == F.col("item"))
        .groupBy("digest")
        .agg(
            F.max("doc_id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.max("rows").alias("rows"),
        )
    )
    large = (F.col("group_size") > 1) & (F.col("group_size") * capacity > F.col("rows"))
    return counted.where(large).select("digest", "keep_id", "group_size")


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)``, one row per input row.

    Of rows with equal text the largest ``doc_id`` stays. Null texts equal empty ones. Rows that
    repeat id and text are one document told twice: they carry the same values, ``kept``
    included. A null id stays only where its group has no other. An empty table gives none.
    """
    digests = stage(text_digests(docs, doc_id, text), "exact-digests")
    winners = stage(frequent_digests(digests, capacity), "exact-frequent")
    settled = digests.join(F.broadcast(winners), "digest")
    group = W.partitionBy("digest")
    rest = (
        digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("keep_id", F.max("doc_id").over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group).cast(T.LongType()))
    )
    columns = ["doc_id", "keep_id", "group_size"]
    return (
        settled.select(*columns, "digest")
        .unionByName(rest.select(*columns, "digest"))
        .select(*columns, F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Ids must be unique here."""
    dropped = exact_groups(docs, doc_id, text).where(~F.col("kept")).select(
        F.col("doc_id").alias("_dropped")
    )
    return docs.join(dropped, docs[doc_id] == F.col("_dropped"), "left_anti")
