"""Lookup index: the release table folded to what lookups ask of it.

An entry says that a release can win, under ``key``, by ``rule``, for ``date``, at ``order``
(smallest first). Folding keeps the best entry and the number of releases per key, rule and
date, map-side first, so a vendor holding a third of the corpus reaches the shuffle as its
distinct dates. Built once, an index serves any number of requests; a stream builds it
before its first batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import undashed
from ..functions.tags import first_tag, has_tag
from .releases import PATCH, match_columns, order_by, position, tagged_patches
from .staging import stage

ENTRY = ["key", "rule", "date"]
BY_TAG, BY_DATE, NEWEST, CORPUS = 0, 1, 2, 3


def _first() -> Column:
    """Order by position alone."""
    return order_by(F.lit(0), F.col("pos"))


def _entry(key: Column, rule: int, date: Column, order: Column) -> Column:
    return F.struct(
        key.alias("key"), F.lit(rule).alias("rule"), date.alias("date"), order.alias("order")
    )


def _corpus() -> Column:
    return _entry(F.lit(""), CORPUS, F.lit(""), _first())


def _explode(docs: DataFrame, entries: Column) -> DataFrame:
    return docs.select(F.explode(entries).alias("e")).select("e.*")


def product_entries(releases: DataFrame) -> DataFrame:
    """By product: the name and every tag, folded, with each release date. Rows without a
    key count the corpus."""
    names = F.array_distinct(F.concat(F.array("name_lower"), F.col("tags_lower")))
    keyed = match_columns(releases).select(
        F.explode(F.array_append(names, F.lit(None))).alias("key"), "date_norm", "newest", "pos"
    )
    counting = F.col("key").isNull()
    return keyed.select(
        F.coalesce("key", F.lit("")).alias("key"),
        F.when(counting, CORPUS).otherwise(BY_DATE).alias("rule"),
        F.when(counting, "").otherwise(F.col("date_norm")).alias("date"),
        F.when(counting, _first()).otherwise(F.col("newest")).alias("order"),
    )


def vendor_entries(releases: DataFrame, match: str = "first_tag") -> DataFrame:
    """By vendor: patch releases under their first tag, or, with ``match='any_field'``, under
    every tag, the name and the brand."""
    docs = match_columns(releases)
    patches = tagged_patches(docs)
    if match == "first_tag":
        # Request dates have eight digits at most, so no other tag can be one.
        dates = F.filter(F.col("tags"), lambda t: t.rlike(r"\A[0-9]{1,8}\z"))
        tagged = F.transform(dates, lambda t: _entry(F.col("key"), BY_TAG, t, _first()))
    else:
        fields = F.array_distinct(F.concat("tags_lower", F.array("name_lower", "brand_lower")))
        patches = patches.withColumn("key", F.explode(fields))
        tagged = None
    entries = F.array(
        _entry(F.col("key"), BY_DATE, F.col("date_norm"), _first()),
        _entry(F.col("key"), NEWEST, F.lit(""), F.col("newest")),
    )
    if tagged is not None:
        entries = F.concat(entries, tagged)
    return _explode(patches, entries).unionByName(_explode(docs, F.array(_corpus())))


def date_entries(releases: DataFrame) -> DataFrame:
    """By date alone, for a feed already narrowed to its vendor: the first eight characters
    of the release date without dashes."""
    stem = F.substring(undashed(F.col("release_date")), 1, 8)
    entries = F.array(
        _entry(F.lit(""), BY_DATE, stem, _first()),
        _entry(F.lit(""), NEWEST, F.lit(""), F.col("newest")),
        _corpus(),
    )
    return _explode(match_columns(releases), entries)


def all_entries(releases: DataFrame, wanted: dict[str, Column], match: str = "first_tag") -> DataFrame:
    """The entries of the three lookups, by ``lookup``, from one pass over the releases.
    ``wanted`` holds, in the order product, vendor, date, the name of each lookup and the
    condition on releases that it may choose.

    A release is exploded to plain texts, sorts of entries behind one another, and a row finds its sort by
    its number: lists of whole entries would be built by interpreted functions, element by element."""
    flags = {f"in_{n}": F.coalesce(c, F.lit(False)) for n, c in enumerate(wanted.values())}
    docs = match_columns(releases, **flags)
    stem = F.substring(undashed(F.col("release_date")), 1, 8)
    docs = docs.withColumns({"earliest": _first(), "stem": stem, "head": first_tag(F.col("tags_lower"))})
    product, vendor, date = zip(wanted, map(F.col, flags))
    is_patch = (vendor[0], vendor[1] & has_tag(F.col("tags_lower"), PATCH))
    item, blank, one = F.col("item"), F.lit(""), F.array(F.lit(""))
    date_norm, newest, earliest = F.col("date_norm"), F.col("newest"), F.col("earliest")
    nulls = F.array(F.lit(None).cast("string"))
    names = F.array_except(F.concat(F.array("name_lower"), F.col("tags_lower")), nulls)  # each once
    # By sort: the lookup, the condition, the texts, and of each text the entry.
    sorts = [
        (*product, one, item, CORPUS, blank, earliest),
        (*product, names, item, BY_DATE, date_norm, newest),
        (*vendor, one, item, CORPUS, blank, earliest),
    ]
    if match == "first_tag":
        dates = F.filter(F.col("tags"), lambda t: t.rlike(r"\A[0-9]{1,8}\z"))
        keys, tagged = F.array("head"), [(*is_patch, dates, F.col("head"), BY_TAG, item, earliest)]
    else:
        keys, tagged = F.array_except(F.concat("tags_lower", F.array("name_lower", "brand_lower")), nulls), []
    sorts += [(*is_patch, keys, item, BY_DATE, date_norm, earliest), (*is_patch, keys, item, NEWEST, blank, newest), *tagged]
    sorts += [
        (*date, one, item, CORPUS, blank, earliest),
        (*date, one, item, BY_DATE, F.col("stem"), earliest),
        (*date, one, item, NEWEST, blank, newest),
    ]
    none = F.array().cast("array<string>")
    texts = {f"of_{n}": F.when(chosen, F.coalesce(items, none)).otherwise(none) for n, (_, chosen, items, *_) in enumerate(sorts)}
    carried = ["date_norm", "newest", "earliest", "stem", "head"]
    sizes = [F.size(c) for c in texts]
    ends = [sum(sizes[1 : n + 1], sizes[0]).alias(f"end_{n}") for n in range(len(sizes) - 1)]
    rows = docs.select(*carried, *[c.alias(name) for name, c in texts.items()])
    rows = rows.select(*carried, *ends, F.concat(*texts).alias("items"))
    rows = rows.select(*carried, *[f"end_{n}" for n in range(len(ends))], F.posexplode("items").alias("number", "item"))

    def by_sort(values: list[Column]) -> Column:
        told = F
        for n, value in enumerate(values[:-1]):
            told = told.when(F.col("number") < F.col(f"end_{n}"), value)
        return told.otherwise(values[-1])

    lookups, _, _, keys, rules, on, orders = zip(*sorts)
    return rows.select(
        by_sort(keys).alias("key"),
        by_sort([F.lit(r) for r in rules]).alias("rule"),
        by_sort(on).alias("date"),
        by_sort(orders).alias("order"),
        by_sort([F.lit(name) for name in lookups]).alias("lookup"),
    )


def fold_entries(entries: DataFrame, *also_by: str) -> DataFrame:
    """The best entry and the number of releases per key, rule and date, folded by hashing,
    map-side first."""
    return entries.groupBy(*also_by, *ENTRY).agg(
        F.min("order").alias("order"), F.count(F.lit(1)).alias("n")
    )


def build(entries: DataFrame, *also_by: str, work_folder: str | None = None) -> DataFrame:
    """The folded entries, staged: lookups read them several times, and the releases as often as
    ``entries`` does."""
    return stage(fold_entries(entries, *also_by), "index", work_folder)


def corpus_size(index: DataFrame) -> Column:
    """Number of indexed releases, as a scalar subquery; null for none."""
    return index.where(F.col("rule") == CORPUS).select("n").scalar()


def first_position(index: DataFrame) -> Column:
    """Position of the first release, as a scalar subquery; null for none."""
    return index.where(F.col("rule") == CORPUS).select(position(F.col("order"))).scalar()
