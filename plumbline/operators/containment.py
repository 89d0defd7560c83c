"""Containment join: which needles occur inside which texts.

"Text contains name" is a theta join, and run as one it compares every text with every
name. Here it becomes two equi-joins. Each position of a text yields a short head; a table
with one row per head tells which needle lengths begin with it; only those lengths are cut
out of the text and looked up. Work grows with the text length, and every pair emitted is
a true match.

A row for a position carries a piece of the text, never more than two ``ANCHOR`` lengths. Needles longer
than that are looked for by an anchor: of their stretches of that length, the one that the fewest
needles share. Where an anchor is found, the whole needle is compared with the text around it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Size, measure, stage

PIECE = 32
#: Characters of a needle that are looked for; a needle may have any number.
ANCHOR = 64


def find_needles(
    texts: DataFrame, text: str, needles: DataFrame, needle: str, head: int = 1
) -> DataFrame:
    """The columns of both sides plus ``start``: one row per occurrence.

    For short texts such as tags: a row per position carries the text. ``needles`` must hold each
    needle once and none shorter than ``head`` characters. The optimizer chooses how to join.
    """
    return _find(texts, text, needles, needle, _heads(needles, needle, head), head)


def find_in_texts(
    texts: DataFrame, text: str, needles: DataFrame, needle: str, head: int = 1
) -> DataFrame:
    """The same for texts of any length against a dictionary.

    The dictionary is measured (a small job) and broadcast when it fits. Texts are cut into
    pieces that overlap by the longest needle or anchor: a row per position then carries a piece,
    not the text, and a long text costs no more per character than a short one. ``texts`` should
    carry a short key besides the text, with a row each; ``text`` itself is not returned.
    """
    size = measure(needles, needle)
    if size.longest <= ANCHOR:
        return _find_short(texts, text, needles, needle, head, size)
    short = needles.where(F.length(needle) <= ANCHOR)
    found = _find_short(texts, text, short, needle, head, Size(size.fits, ANCHOR))
    return found.unionByName(_find_long(texts, text, needles.where(F.length(needle) > ANCHOR), needle, size.fits))


def anchors(needles: DataFrame, needle: str) -> DataFrame:
    """``(needle, _anchor, _offset)`` of long needles: of the stretches of ``ANCHOR`` characters that
    begin at every half of one, and the last, the one that the fewest needles have; the first of those."""
    steps = F.sequence(F.lit(0), F.length(needle) - ANCHOR, F.lit(ANCHOR // 2))
    offsets = F.array_union(steps, F.array(F.length(needle) - ANCHOR))
    grams = needles.select(needle, F.explode(offsets).alias("_offset"))
    grams = grams.withColumn("_anchor", F.substring(needle, F.col("_offset") + 1, F.lit(ANCHOR)))
    shared = grams.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_shared"))
    rarest = F.min(F.struct("_shared", "_offset", "_anchor")).alias("_rarest")
    return grams.join(shared, "_anchor").groupBy(needle).agg(rarest).select(needle, "_rarest._anchor", "_rarest._offset")


def _find_long(texts: DataFrame, text: str, needles: DataFrame, needle: str, fits: bool) -> DataFrame:
    """Occurrences of long needles: those of their anchors, where the rest agrees as well."""
    keys = [c for c in texts.columns if c != text]
    anchored = stage(anchors(needles, needle), "anchors")
    looked_for = anchored.select("_anchor").distinct()
    hits = _find_short(texts, text, looked_for, "_anchor", 2, Size(fits, ANCHOR))
    sides = anchored.join(needles, needle)
    placed = hits.join(sides, "_anchor").withColumn("start", F.col("start") - F.col("_offset"))
    placed = placed.where(F.col("start") >= 1).drop("_anchor", "_offset")
    own = texts.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col(text).alias("_whole"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    around = F.substring("_whole", F.col("start"), F.length(needle))
    found = placed.join(own, same).where(around == F.col(needle))
    return found.drop("_whole", *[f"_{c}" for c in keys])


def text_pieces(texts: DataFrame, text: str, step: int, overlap: int) -> DataFrame:
    """The other columns with ``_n``, ``own`` and ``_text``: pieces of ``step`` characters, with as many
    of the next one's as ``overlap``; ``own`` are those of the piece itself."""
    keys = [c for c in texts.columns if c != text]
    following = F.concat(
        F.slice("_cut", 2, F.greatest(F.size("_cut") - 1, F.lit(0))), F.array(F.lit(""))
    )
    overlapping = F.zip_with(
        "_cut",
        following,
        lambda own, after: F.struct(
            F.length(own).alias("own"),
            F.concat(own, F.substring(after, 1, overlap)).alias("text"),
        ),
    )
    return (
        texts.select(*keys, _pieces(F.col(text), step).alias("_cut"))
        .select(*keys, F.posexplode(overlapping).alias("_n", "_piece"))
        .select(*keys, "_n", "_piece.own", F.col("_piece.text").alias("_text"))
    )


def _find_short(texts: DataFrame, text: str, needles: DataFrame, needle: str, head: int, size: Size) -> DataFrame:
    """Occurrences of needles that are not longer than an anchor."""
    heads = _heads(needles, needle, head)
    if size.fits:  # then its heads fit too
        needles, heads = F.broadcast(needles), F.broadcast(heads)
    step, overlap = max(PIECE, size.longest), max(size.longest - 1, 0)
    pieces = text_pieces(texts, text, step, overlap)
    found = _find(pieces, "_text", needles, needle, heads, head, F.col("own"))
    return found.withColumn("start", F.col("_n") * step + F.col("start")).drop(
        "_n", "own", "_text"
    )


def _pieces(text: Column, step: int) -> Column:
    """Consecutive pieces of ``step`` characters."""
    return F.when(F.length(text) <= step, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    )


def _heads(needles: DataFrame, needle: str, head: int) -> DataFrame:
    return needles.groupBy(F.substring(needle, 1, head).alias("_head")).agg(
        F.collect_set(F.length(needle)).alias("_lengths")
    )


def _cut(text: Column, start: Column, length: Column) -> Column:
    """A substring the optimizer knows is never null; else it cuts twice, to test the key."""
    return F.coalesce(F.substring(text, start, length), F.lit(""))


def _find(texts, text, needles, needle, heads, head, last_start=None) -> DataFrame:
    body = F.col(text)
    last = F.length(body) - head + 1
    if last_start is not None:  # starts beyond belong to the next piece
        last = F.least(last, last_start)
    cuts = (
        texts.where(F.length(body) >= head)
        .withColumn("start", F.explode(F.sequence(F.lit(1), last)))
        .withColumn("_head", _cut(body, F.col("start"), F.lit(head)))
        .join(heads, "_head")
        .withColumn("_length", F.explode("_lengths"))
        .where(F.col("start") + F.col("_length") - 1 <= F.length(body))
        .withColumn(needle, _cut(body, F.col("start"), F.col("_length")))
        .drop("_head", "_lengths", "_length")
    )
    return cuts.join(needles, needle)
