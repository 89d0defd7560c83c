"""Landed JSON: response bodies, one per row, unwrapped into release and vendor tables.

A landed table has ``page`` (the order of the bodies) and ``body`` (the JSON text). The
position of an item is its page and index, so ties resolve as they did in the list.

Bodies up to ``LARGE`` bytes are parsed as variants, one in one task. A variant has a size limit and a
task its time, so larger bodies are cut at the commas of their lists and their items parsed by many
tasks (``bodies.py``). What a body holds does not depend on the way: complete, or nothing when it is
no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RAW_RELEASE, RELEASE_FIELDS
from .bodies import list_items, parse_strictly, read_pieces, write_bodies

# Where a body that is not itself a list keeps its list; the first field that
# is not null decides, even when it holds no list.
COMPONENT_FIELDS = ("components", "data")
PATCH_FIELDS = ("data", "components")
NAME_FIELDS = ("names", "data")

PAGE_SPAN = 2**32
LARGE = 16 * 1024 * 1024  # an eighth of the limit, since a parsed body may be longer than its text


def _is_array(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def unwrap(landed: DataFrame, item: T.DataType, fields: tuple[str, ...]) -> DataFrame:
    """``(page, pos, item)``: the items of every body. A body that is no JSON, or whose list
    is missing or something else, has none. Looks first whether there are large bodies."""
    size = F.octet_length("body")
    found = _items(landed.where(size <= LARGE), fields)
    large = landed.where(size > LARGE)
    if not large.isEmpty():
        found = found.unionByName(_large_items(large, fields))
    return _typed(found, item)


def unwrap_files(spark: SparkSession, folder: str, item: T.DataType, fields: tuple[str, ...]) -> DataFrame:
    """The same for bodies landed as files, ``id=<number>/page=<number>/…``, one in each. Files are read in
    byte ranges, whatever their size."""
    return _typed(list_items(read_pieces(spark, folder), fields), item)


def _typed(items: DataFrame, item: T.DataType) -> DataFrame:
    """Items as the type asked for; what does not fit it is null."""
    listed = F.from_json(F.concat(F.lit("["), F.to_json("item"), F.lit("]")), T.ArrayType(item))
    pos = F.col("page") * PAGE_SPAN + F.col("index")
    return items.select("page", pos.alias("pos"), F.get(listed, F.lit(0)).alias("item"))


def _large_items(landed: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return list_items(read_pieces(landed.sparkSession, write_bodies(landed)), fields)


def _items(landed: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``(page, index, item)`` of bodies that a task can parse."""
    inner = [F.try_variant_get("parsed", f"$.{f}", "variant") for f in fields]
    chosen = F.coalesce(
        F.when(_is_array(F.col("parsed")), F.col("parsed")),
        *[F.when(~F.is_variant_null(v), v) for v in inner],
    )
    return (
        parse_strictly(landed, F.col("body"), "parsed")
        .withColumn("chosen", chosen)
        .where(_is_array(F.col("chosen")))
        .select("page", F.posexplode(F.col("chosen").cast("array<variant>")).alias("index", "item"))
        .select("page", F.col("index").cast("bigint").alias("index"), "item")
    )


def releases_from(landed: DataFrame, fields: tuple[str, ...] = COMPONENT_FIELDS) -> DataFrame:
    """Curated releases of landed documents."""
    columns = []
    for name, _, raw in RELEASE_FIELDS:
        value = F.col(f"item.{raw}")
        if name == "ts_ms":  # a number, or a text that holds one
            value = F.expr(f"try_cast(try_cast(item.{raw} as double) as bigint)")
        if name == "tags":
            value = F.coalesce(value, F.col("item.version_search_tags"))
        columns.append(value.alias(name))
    return unwrap(landed, RAW_RELEASE, fields).select("pos", *columns)


def vendor_names_from(landed: DataFrame) -> DataFrame:
    """``(pos, name)`` of landed name lists."""
    return unwrap(landed, T.StringType(), NAME_FIELDS).select("pos", F.col("item").alias("name"))


def first_filled(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The secondary list only when the primary has no row."""
    size = primary.limit(1).agg(F.count(F.lit(1))).scalar()
    return primary.unionByName(secondary.where(size == 0))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The vendor list of the newest ``snapshot_ts``; earlier ones serve while it is missing."""
    newest = snapshots.agg(F.max("snapshot_ts")).scalar()
    return snapshots.where(F.col("snapshot_ts") == newest).select("pos", "name")


def list_vendors(vendor_names: DataFrame, limit: int | None = None) -> DataFrame:
    """Names in list order, with a display limit where wanted."""
    ordered = vendor_names.select("pos", "name").orderBy("pos")
    return ordered if limit is None else ordered.limit(limit)


