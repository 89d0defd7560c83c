"""One JSON body over many tasks.

A body is read as text in byte ranges, broken at every comma. A piece between two commas may begin
inside a string or not, and at any depth. Both follow from what is before it, as sums: quotes that
are not escaped decide the one, brackets outside strings the other. Sums are taken inside a block
(what one task reads) and over the blocks of a body, so no window is longer than a block.

Commas outside strings at the depth of the list cut a body into segments: the items of a list, and in
an envelope the members and the items of members that are lists. Each segment is parsed by itself.
A body is whole when its brackets and quotes close, every segment parses, every comma stands between
two segments, and no member is named twice; any other body has no items, as one that is no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators.staging import join_side, new_folder, stage

#: White space of JSON.
BLANK = r"[ \t\r\n]*"
_ESCAPED, _STRING, _OPEN_STRING = r"(?s)\\.", r'"[^"]*"', r'(?s)".*'
BLOCK = ["id", "block"]


def parse_strictly(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds a variant: ``text`` as one JSON value with nothing behind it, else null. The parser stops
    where a value ends, so it is given a list of the text and a hash of it, and has to find both."""
    mark = F.xxhash64(text)
    both = F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]"))
    rows = rows.withColumns({"_mark": mark, "_both": F.try_parse_json(both)})
    found = F.when(
        F.try_variant_get("_both", "$[1]", "bigint") == F.col("_mark"), F.try_variant_get("_both", "$[0]", "variant")
    )
    return rows.withColumn(name, found).drop("_mark", "_both")


def write_bodies(landed: DataFrame) -> str:
    """Bodies ``(page, body)`` as files, each in a folder ``id=…/page=…``, for :func:`read_pieces`."""
    folder = new_folder(landed.sparkSession, "bodies")
    rows = landed.select(F.monotonically_increasing_id().alias("id"), "page", "body")
    rows.write.partitionBy("id", "page").text(folder)
    return folder


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, page, block, at, text, bytes)``: the text of each body broken at commas. A file
    ``id=<number>/page=<number>/…`` holds one body and is read by as many tasks as it has blocks."""
    reader = spark.read.schema("value string, id bigint, page bigint").option("lineSep", ",")
    return reader.text(folder).select(
        "id",
        "page",
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("text"),
        F.col("_metadata.file_size").alias("bytes"),
    )


def _before(sums: DataFrame, *names: str) -> DataFrame:
    """Sums over the blocks before each; a row for each block."""
    along = W.partitionBy("id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return sums.select(*BLOCK, *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"{c}_before") for c in names])


def _with_blocks(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with what the blocks before theirs add up to."""
    sums = rows.groupBy(*BLOCK).agg(*[F.sum(c).alias(c) for c in names])
    return rows.join(join_side(stage(_before(sums, *names), "blocks")), BLOCK)


def _upto(name: str) -> Column:
    """The sum up to a row, over the whole body."""
    inside = W.partitionBy(*BLOCK).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.col(f"{name}_before") + F.sum(name).over(inside)


def _marked(pieces: DataFrame) -> DataFrame:
    """Pieces with ``quoted``, whether the comma behind lies in a string, ``depth`` there, and ``last``."""
    plain = F.regexp_replace("text", _ESCAPED, "")  # no escape reaches over a comma
    quotes = F.char_length(plain) - F.char_length(F.replace(plain, F.lit('"')))
    # Escapes matter inside strings only; outside, a backslash makes the segment fail.
    rows = stage(pieces.withColumns({"quotes": quotes.cast("bigint"), "plain": plain}), "pieces")
    rows = _with_blocks(rows, "quotes").withColumn("quotes_upto", _upto("quotes"))
    begins_quoted = (F.col("quotes_upto") - F.col("quotes")) % 2 == 1
    whole = F.concat(F.when(begins_quoted, '"').otherwise(""), F.col("plain"))
    outside = F.regexp_replace(F.regexp_replace(whole, _STRING, ""), _OPEN_STRING, "")
    opened, closed = (F.char_length(outside) - F.char_length(F.regexp_replace(outside, c, "")) for c in (r"[\[{]", r"[\]}]"))
    rows = rows.withColumns({"delta": (opened - closed).cast("bigint"), "quoted": F.col("quotes_upto") % 2 == 1})
    rows = stage(rows.select(*BLOCK, "page", "at", "text", "bytes", "quoted", "delta"), "depths")
    return _with_blocks(rows, "delta").withColumn("depth", _upto("delta")).drop("delta", "delta_before")


def segments(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, page, kind, whole)`` of bodies, ``kind`` being the first character; and ``(id, member,
    segment, text)``: what the commas at the depth of lists cut, members only of envelopes."""
    marked = stage(_marked(pieces), "marked")
    place = F.struct("block", "at")
    bodies = marked.groupBy("id").agg(
        F.any_value("page").alias("page"),
        F.min_by("text", place).alias("head"),
        F.max(F.struct(place.alias("place"), "quoted", "depth")).alias("end"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("text")).alias("text_bytes"),
        F.max("bytes").alias("bytes"),
    )
    # The reader shows no piece behind a comma that ends a file.
    closed = ~F.col("end.quoted") & (F.col("end.depth") == 0) & (F.col("text_bytes") + F.col("n") != F.col("bytes"))
    kind = F.regexp_extract("head", rf"\A{BLANK}(.)", 1)
    bodies = stage(bodies.select("id", "page", kind.alias("kind"), closed.alias("closed"), F.col("end.place").alias("final")), "body-ends")
    rows = marked.drop("page").join(join_side(bodies), "id")
    outside = ~F.col("quoted") & (place != F.col("final"))
    enclosed = F.col("kind") == "{"
    flags = {
        "new_segment": outside & (F.col("depth") <= F.when(enclosed, 2).otherwise(1)),
        "new_member": outside & (F.col("depth") <= 1) & enclosed,
        "stray": outside & (F.col("depth") < 1),
    }
    rows = rows.withColumns({c: flag.cast("bigint") for c, flag in flags.items()})
    rows = stage(rows.select(*BLOCK, "at", "text", *flags), "cuts")
    rows = _with_blocks(rows, "new_segment", "new_member")
    rows = rows.withColumns({n: _upto(f"new_{n}") - F.col(f"new_{n}") for n in ("segment", "member")})
    cut = rows.groupBy("id", "member", "segment").agg(_joined("block", "at").alias("text"), F.sum("stray").alias("stray"))
    cut = stage(cut, "segments")
    stray = cut.groupBy("id").agg(F.sum("stray").alias("stray"))
    whole = F.col("closed") & (F.col("stray") == 0)
    return bodies.join(stray, "id").select("id", "page", "kind", whole.alias("whole")), cut.drop("stray")


def _joined(*order: str) -> Column:
    """Texts of a group put together again, in order."""
    bits = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return F.array_join(F.transform(bits, lambda b: b["text"]), ",")


def list_items(pieces: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``(page, index, item)``: the items, as variants, of the list that a body is or that the first
    of ``fields`` that is not null holds. Bodies that are not whole have none. Members that are not
    lists are parsed whole, in one task each."""
    bodies, cut = segments(pieces)
    name = rf'(?s)\A(?:{BLANK}\{{)?{BLANK}("(?:[^"\\]|\\.)*"){BLANK}:{BLANK}'
    enclosed = F.col("kind") == "{"
    members = cut.groupBy("id", "member").agg(
        F.min("segment").alias("first"), F.max("segment").alias("final"), F.min_by("text", "segment").alias("head")
    )
    ends = cut.groupBy("id").agg(F.max("member").alias("last_member"))
    said = F.from_json(F.concat(F.lit("["), F.regexp_extract("head", name, 1), F.lit("]")), "array<string>")
    members = members.join(bodies, "id").join(ends, "id").select(
        "id", "member", "first", "final", "kind", "whole", (F.col("member") == F.col("last_member")).alias("is_last"),
        F.when(enclosed, F.get(said, F.lit(0))).alias("name"),
        F.when(enclosed, F.col("head").rlike(name + r"\[")).otherwise(F.col("kind") == "[").alias("is_list"),
        F.col("head").rlike(rf"\A{BLANK}\{{{BLANK}\}}{BLANK}\z").alias("empty"),
    )
    members = stage(members, "members")
    rows = cut.join(join_side(members), ["id", "member"])

    # Lists: their segments without the brackets of the list.
    begins, at_end = F.col("segment") == F.col("first"), F.col("segment") == F.col("final")
    bare = F.when(enclosed, F.regexp_replace("text", name + r"\[", "")).otherwise(F.regexp_replace("text", rf"\A{BLANK}\[", ""))
    text = F.when(begins, bare).otherwise(F.col("text"))
    tails = (rf"\]{BLANK}\}}{BLANK}\z", rf"\]{BLANK}\z")
    closes_both = enclosed & F.col("is_last")
    ended = F.when(closes_both, text.rlike(tails[0])).otherwise(text.rlike(tails[1]))
    short = F.when(closes_both, F.regexp_replace(text, tails[0], "")).otherwise(F.regexp_replace(text, tails[1], ""))
    listed = rows.where("is_list").select(
        "id", "member", (F.col("segment") - F.col("first")).alias("index"),
        (begins & at_end).alias("alone"), (at_end & ~ended).alias("open_end"),
        F.when(at_end, short).otherwise(text).alias("text"),
    )
    none = F.col("alone") & F.col("text").rlike(rf"\A{BLANK}\z")
    listed = parse_strictly(listed.withColumn("none", none), F.col("text"), "item")
    listed = stage(listed.drop("text", "alone"), "list-items")

    # Other members, each as an object of one member.
    others = rows.where(~F.col("is_list") & enclosed).groupBy("id", "member", "is_last").agg(_joined("segment").alias("text"))
    begun = F.when(F.col("member") == 0, F.col("text")).otherwise(F.concat(F.lit("{"), "text"))
    is_null = F.col("text").rlike(name + rf"null{BLANK}\}}?{BLANK}\z")
    others = parse_strictly(others, F.when(F.col("is_last"), begun).otherwise(F.concat(begun, F.lit("}"))), "value")
    others = stage(others.select("id", "member", F.col("value").isNull().alias("broken"), is_null.alias("is_null")), "other-members")

    twice = members.where("name is not null").groupBy("id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    unnamed = enclosed & F.col("name").isNull() & ~F.col("empty")
    broken = (
        members.where(~F.col("whole") | ~F.col("kind").isin("[", "{") | unnamed).select("id")
        .union(listed.where(F.col("open_end") | (F.col("item").isNull() & ~F.col("none"))).select("id"))
        .union(others.where("broken").select("id"))
        .union(twice.select("id"))
    )
    rank = F.array_position(F.array(*map(F.lit, fields)), F.col("name"))
    offered = members.where(enclosed & (rank > 0)).join(others.where("is_null"), ["id", "member"], "left_anti")
    chosen = offered.groupBy("id").agg(F.min_by("member", rank).alias("member"))
    chosen = chosen.unionByName(members.where(F.col("kind") == "[").select("id", "member"))
    chosen = chosen.join(broken.distinct(), "id", "left_anti").join(bodies.select("id", "page"), "id")
    chosen = stage(chosen, "chosen-members")
    return listed.where(~F.col("none")).join(join_side(chosen), ["id", "member"]).select("page", "index", "item")
