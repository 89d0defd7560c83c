"""Evidence lookups: the one release that answers each request.

A lookup takes ``requests(key, date)``, each pair once, ``date`` as digits and empty when
none was asked. It returns them with ``pos``, the chosen release, null when there is none.
Each has two forms: one that reads the release table, and one (``pick_…``) that reads a
folded index. Only positions travel; the texts of the chosen releases are fetched at the
end by :func:`attach_releases`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_digits, day_number
from ..functions.text import text_key
from .containment import find_in_texts, find_needles
from .index import (
    BY_DATE,
    BY_TAG,
    CORPUS,
    NEWEST,
    build,
    date_entries,
    first_position,
    product_entries,
    vendor_entries,
)
from .nearest import nearest_points
from .releases import match_columns, position
from .staging import measure, stage

DATED_LENGTH = 6


def product_release(
    requests: DataFrame, releases: DataFrame, fallback: str = "first", distance: str = "digits"
) -> DataFrame:
    """The release of a product nearest to a date, or its newest one without a date.

    A product matches a release by its name or one of its tags, whole and folded. The same
    date wins over the nearest; among equals the newest does. An unknown product gets the
    first release of the corpus, or nothing with ``fallback='none'``. Dates are as far apart as
    their digits are, or with ``distance='days'`` as many days; what is no calendar date then has no
    distance.
    """
    entries = keep_asked(product_entries(releases), requests)
    return pick_product(requests, build(entries), fallback, distance)


def keep_asked(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Product entries of the requested keys, and those that count the corpus."""
    wanted = requests.select("key").union(requests.sparkSession.range(1).select(F.lit("")))
    return entries.join(wanted.distinct(), "key", "left_semi")


def _point(date: Column, distance: str) -> Column:
    return day_number(date) if distance == "days" else date.try_cast("int")


def pick_product(
    requests: DataFrame, index: DataFrame, fallback: str = "first", distance: str = "digits"
) -> DataFrame:
    if distance not in ("digits", "days"):
        raise ValueError(f"no distance {distance!r}")
    dated = (
        index.where(F.col("rule") == BY_DATE)
        .select("key", "date", F.col("order").alias("same"))
        .join(requests.select("key").distinct(), "key", "left_semi")
    )
    newest = dated.groupBy("key").agg(F.min("same").alias("latest"))
    points = (
        dated.where(F.length("date") >= DATED_LENGTH)
        .groupBy("key", _point(F.col("date"), distance).alias("at"))
        .agg(F.min("same").alias("best"))
        .where(F.col("at").isNotNull())
    )
    asked = requests.where(F.col("date") != "")
    probes = asked.select("key", _point(F.col("date"), distance).alias("at")).distinct()
    nearest = nearest_points(probes, points).withColumnRenamed("best", "near")
    found = (
        requests.withColumn("at", _point(F.col("date"), distance))
        .join(dated.where(F.col("date") != ""), ["key", "date"], "left")
        .join(nearest, ["key", "at"], "left")
        .join(newest, "key", "left")
    )
    pos = F.coalesce(*[position(F.col(c)) for c in ("same", "near", "latest")])
    if fallback == "first":
        pos = F.coalesce(pos, first_position(index))
    return found.select("key", "date", pos.alias("pos"))


def latest_per_product(releases: DataFrame) -> DataFrame:
    """``(key, pos)``: the newest release of each product name."""
    return (
        match_columns(releases)
        .groupBy(F.col("name_lower").alias("key"))
        .agg(F.min("newest").alias("best"))
        .select("key", position(F.col("best")).alias("pos"))
    )


def vendor_patch(
    requests: DataFrame, releases: DataFrame, match: str = "first_tag"
) -> DataFrame:
    """The patch release of a vendor for a date, or its newest one.

    A release qualifies when its tags hold ``patch`` and its first tag contains the vendor
    or the vendor contains it (an empty first tag matches everyone). The first release with
    the date among its tags wins, then the first with that release date, then the newest.
    ``match='any_field'`` instead looks for the vendor inside any tag, the name or the
    brand, and goes by release date only.
    """
    return pick_vendor(requests, build(vendor_entries(releases, match)), match)


def pick_vendor(requests: DataFrame, index: DataFrame, match: str = "first_tag") -> DataFrame:
    """Vendors are free text and travel as their key. The two directions of containment scale
    apart. A tag inside a vendor: vendors are many, their tags few, so each vendor's own
    dates meet the index by tag and date. A vendor inside a tag: a tag has few such vendors, so
    the index, cut to asked dates, is folded per vendor."""
    by_tag = match == "first_tag"
    index = index.where(F.col("rule") != CORPUS).select("key", "rule", F.col("date").alias("on"), "order")
    asked = requests.select(
        F.col("key").alias("vendor"),
        text_key(F.col("key")).alias("vendor_key"),
        date_digits(F.col("date")).alias("digits"),
        "date",
    )
    vendors = asked.select("vendor_key", "vendor").distinct()
    keys = index.select("key").distinct()

    def probe(rule: int, on: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), on.alias("on"))

    newest, exact = probe(NEWEST, F.lit("")), probe(BY_DATE, F.col("digits"))
    dated = [probe(BY_TAG, F.col("date"))] if by_tag else []
    rules = F.when(F.col("date") == "", F.array(newest)).otherwise(F.array(*dated, exact, newest))
    probes = asked.select("vendor_key", "date", F.inline(rules))
    own = probes.select("vendor_key", "rule", "on").distinct()

    def folded(met: DataFrame) -> DataFrame:
        return met.groupBy("vendor_key", "rule", "on").agg(F.min("order").alias("order"))

    holding = find_needles(keys, "key", vendors, "vendor").select("vendor_key", "key").distinct()
    cut = index.join(own.select("rule", "on").distinct(), ["rule", "on"], "left_semi")
    best = folded(cut.join(holding, "key"))
    if by_tag:
        inside = find_in_texts(vendors, "vendor", keys.where(F.col("key") != ""), "key")
        inside = inside.select("vendor_key", "key").distinct()
        anyone = vendors.select("vendor_key", F.lit("").alias("key"))
        tried = own.join(inside.unionByName(anyone), "vendor_key")
        best = folded(best.unionByName(folded(tried.join(index, ["key", "rule", "on"]))))
    chosen = (
        probes.join(best, ["vendor_key", "rule", "on"])
        .groupBy("vendor_key", "date")
        .agg(F.min(F.struct("rule", "order")).alias("best"))
        .select("vendor_key", "date", position(F.col("best.order")).alias("pos"))
    )
    found = requests.withColumn("vendor_key", text_key(F.col("key")))
    return found.select("key", "date", "vendor_key").join(chosen, ["vendor_key", "date"], "left").select("key", "date", "pos")


def dated_patch(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """The release of a candidate set for a date, or its newest one.

    The first release whose date starts with the asked date, or whose first eight
    characters the asked date starts with, wins; an empty release date therefore fits every
    date. Without a fit, or for a date without digits, the first candidate is taken.
    ``requests`` may carry any ``key``; the candidates are the same for all.
    """
    return pick_dated(requests, build(date_entries(candidates)))


def pick_dated(requests: DataFrame, index: DataFrame) -> DataFrame:
    stems = index.where(F.col("rule") == BY_DATE).select(
        F.col("date").alias("stem"), position(F.col("order")).alias("first")
    )
    asked = requests.select("date").where(F.col("date") != "").distinct()
    asked = asked.withColumn("digits", date_digits(F.col("date")))

    # "Starts with" in either direction, as equality of prefixes.
    def prefixes(name: str) -> Column:
        ends = F.sequence(F.lit(0), F.length(name))
        return F.explode(F.transform(ends, lambda n: F.substring(F.col(name), F.lit(1), n)))

    shorter = asked.select("date", prefixes("digits").alias("stem")).join(stems, "stem")
    longer = (
        stems.select(prefixes("stem").alias("digits"), "first")
        .groupBy("digits")
        .agg(F.min("first").alias("first"))
        .join(asked, "digits")
    )
    fitting = (
        shorter.select("date", "first")
        .unionByName(longer.select("date", "first"))
        .groupBy("date")
        .agg(F.min("first").alias("fit"))
    )
    newest = index.where(F.col("rule") == NEWEST).select(position(F.col("order"))).scalar()
    has_digits = date_digits(F.col("date")) != ""
    pos = F.when(F.col("date") == "", newest).otherwise(
        F.coalesce(F.when(has_digits, F.col("fit")), first_position(index))
    )
    return (
        requests.select("key", "date")
        .join(fitting, "date", "left")
        .select("key", "date", pos.alias("pos"))
    )


def attach_releases(
    chosen: DataFrame,
    releases: DataFrame | Callable[[DataFrame], DataFrame],
    work_folder: str | None = None,
) -> DataFrame:
    """Add the chosen releases' columns, null where no release was chosen.

    The choice is staged and measured before the wide table is touched: when its positions
    fit a broadcast, the table is filtered where it is read and never shuffled. ``releases`` may
    be a function of the wanted positions that reads only the parts which may hold them.
    """
    chosen = stage(chosen, "chosen", work_folder)
    wanted = chosen.select("pos").where(F.col("pos").isNotNull()).distinct()
    if callable(releases):
        releases = releases(wanted)
    if measure(wanted).fits:
        wanted = F.broadcast(wanted)
    return chosen.join(releases.join(wanted, "pos", "left_semi"), "pos", "left")
