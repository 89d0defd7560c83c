"""Answer questions from evidence, or abstain with a reason.

Each distinct text is parsed, resolved and routed once; each distinct request (what to look
for, which key, which date) is looked up once; each answer text is built once per request.
Question rows meet the results in two equi-joins against staged tables. Those are broadcast
only when measured small; otherwise adaptive execution splits a hot text or request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formatting as fmt
from ..functions.dates import unbracketed
from ..functions.tags import mentions_vendor
from ..operators.index import (
    CORPUS,
    all_entries,
    build,
    corpus_size,
    date_entries,
    product_entries,
    vendor_entries,
)
from ..operators.lookups import (
    attach_releases,
    pick_dated,
    pick_product,
    pick_vendor,
)
from ..operators.questions import (
    LINUX_TEXT,
    OS_VERSION,
    PATCH_FOR,
    UNKNOWN,
    add_vendors,
    folded_texts,
    parse,
    route,
    with_texts,
)
from ..operators.release_store import ReleaseStore, Snapshot
from ..operators.releases import PATCH, search_releases
from ..operators.staging import join_side, measure, stage
from ..operators.vendors import name_dictionary
from ..schemas import release_column

LINUX, DEFAULT_PRODUCT = "linux", "android"
REQUEST = ["lookup", "key", "date"]

# Reasons.
VENDOR_NOT_LISTED = "patch_vendor_not_in_names"
FEED_ERROR = "patch_api_error"
NO_TAGGED_PATCH = "patch_not_found_in_search_tags"
NO_RESULTS = "no_results"
WRONG_VENDOR = "versionSearchTags_does_not_have_provided_vendor"
NO_INTENT = "unknown_intent_not_patch_or_os_version"
NO_OS_MATCH = "os_no_match"
ANSWERED = "answered"
SERVER_ERROR = "server_error"


@dataclass(frozen=True)
class Options:
    """How to answer. The defaults are what the README lists under Choices.

    ``fallback='none'`` abstains on an unknown product instead of taking the first release.
    ``boundary`` resolves vendors by whole words. ``strict`` abstains on one repeated
    character. ``day_first`` reads D-M-YYYY. ``evidence_limit`` keeps only the newest
    patches of each feed. ``distance='days'`` takes nearest dates by days, ``repair_dates`` leaves out
    what release dates have in brackets. ``match`` is the rule of :func:`vendor_patch`. ``component_type``
    limits version questions to releases of that product type, where one table holds the
    operating systems and the patches. ``unavailable`` names the sources that could not be
    read: ``"patch"``, ``"os"``.
    """

    fallback: str = "first"
    boundary: bool = False
    strict: bool = False
    day_first: bool = False
    evidence_limit: int | None = None
    distance: str = "digits"
    repair_dates: bool = False
    match: str = "first_tag"
    component_type: str | None = None
    unavailable: frozenset = frozenset()
    source: str = "release table"
    names_source: str = "vendor_names"
    feed_source: str = "releases?channel=patch"
    linux_source: str = "releases?q=linux&channel=patch"


def route_texts(
    questions: DataFrame,
    vendor_names: DataFrame,
    options: Options = Options(),
    work_folder: str | None = None,
) -> DataFrame:
    """Distinct texts with their branch and the request they make, if any. The parsed texts
    and the names are staged: each is read several times, and parsed once."""
    texts = parse(folded_texts(questions), day_first=options.day_first).drop("text")
    texts = stage(texts, "texts", work_folder)
    names = stage(name_dictionary(vendor_names), "names", work_folder)
    routed = route(add_vendors(texts, names, options.boundary), options.strict)
    branch = F.col("branch")
    lookup = F.when((branch == PATCH_FOR) & ~F.col("vendor_in_names"), None).when(
        branch != UNKNOWN, branch
    )
    product = F.lower(F.coalesce(F.col("vendor_name"), F.lit(DEFAULT_PRODUCT)))
    key = (
        F.when(branch == PATCH_FOR, F.col("parsed_vendor"))
        .when(branch == LINUX_TEXT, LINUX)
        .when(branch == OS_VERSION, product)
    )
    return routed.withColumns(
        {"lookup": lookup, "key": key, "date": F.coalesce(F.col("parsed_date"), F.lit(""))}
    )


def feeds(releases: DataFrame, options: Options) -> dict[str, DataFrame]:
    """The candidate releases of each lookup; an unreadable source has none."""
    none = releases.where(F.lit(False))
    patches = none if "patch" in options.unavailable else releases
    components = none if "os" in options.unavailable else releases
    if options.component_type is not None:
        kind = F.lower(release_column(releases, "product_type"))
        components = components.where(kind == options.component_type.lower())

    def patch_feed(vendor=None):
        return search_releases(patches, vendor, PATCH, options.evidence_limit)

    return {
        OS_VERSION: components,
        PATCH_FOR: patch_feed(),
        LINUX_TEXT: patch_feed(LINUX),
    }


def build_index(
    releases: DataFrame,
    options: Options = Options(),
    requests: DataFrame | None = None,
    work_folder: str | None = None,
) -> DataFrame:
    """The staged index of all lookups, folded together. With ``requests``, products nobody
    asks for are left out; without, the index serves any questions on these releases."""
    asked = None
    if requests is not None:
        asked = requests.where(F.col("lookup") == OS_VERSION).select(F.col("key").alias("_asked")).distinct()
        asked = asked if measure(asked).fits else None
    releases = _dated(releases, options)
    if options.evidence_limit is None:
        entries = all_entries(releases, _conditions(releases, options), options.match)
    else:  # the newest of each feed have to be found first
        entries = _limited_entries(releases, options)
    if asked is not None:
        side = entries.join(F.broadcast(asked), F.col("key") == F.col("_asked"), "left")
        needless = (F.col("lookup") == OS_VERSION) & (F.col("rule") != CORPUS) & F.col("_asked").isNull()
        entries = side.where(~needless).drop("_asked")
    return build(entries, "lookup", work_folder=work_folder)


def _conditions(releases: DataFrame, options: Options) -> dict[str, Column]:
    """Which releases each lookup may choose; an unreadable source has none."""
    patches = (F.col("channel") == PATCH) & F.lit("patch" not in options.unavailable)
    components = F.lit("os" not in options.unavailable)
    if options.component_type is not None:
        kind = F.lower(release_column(releases, "product_type"))
        components = components & (kind == options.component_type.lower())
    brand = release_column(releases, "brand")
    linux = patches & mentions_vendor(F.lit(LINUX), F.col("tags"), F.col("name"), brand)
    return {OS_VERSION: components, PATCH_FOR: patches, LINUX_TEXT: linux}


def release_store(spark: SparkSession, path: str, options: Options = Options(), **sizes: int) -> ReleaseStore:
    """A store of releases whose index answers questions with these options. A limit on evidence
    depends on all releases at once and cannot be kept up change by change."""
    if options.evidence_limit is not None:
        raise ValueError("a store has no evidence_limit")

    def entries(releases: DataFrame) -> DataFrame:
        releases = _dated(releases, options)
        return all_entries(releases, _conditions(releases, options), options.match)

    return ReleaseStore(spark, path, entries, **sizes)


def _dated(releases: DataFrame, options: Options) -> DataFrame:
    """Releases with the dates that lookups go by."""
    if not options.repair_dates:
        return releases
    return releases.withColumn("release_date", unbracketed(F.col("release_date")))


def _limited_entries(releases: DataFrame, options: Options) -> DataFrame:
    corpus = feeds(releases, options)
    parts = {
        OS_VERSION: product_entries(corpus[OS_VERSION]),
        PATCH_FOR: vendor_entries(corpus[PATCH_FOR], options.match),
        LINUX_TEXT: date_entries(corpus[LINUX_TEXT]),
    }
    entries = [df.withColumn("lookup", F.lit(lookup)) for lookup, df in parts.items()]
    return entries[0].unionByName(entries[1]).unionByName(entries[2])


def find_evidence(requests: DataFrame, index: DataFrame, options: Options) -> DataFrame:
    """Requests with the position of their release."""

    def of(df, lookup):
        return df.where(F.col("lookup") == lookup).drop("lookup")

    def both(lookup):
        return of(requests, lookup), of(index, lookup)

    found = {
        OS_VERSION: pick_product(*both(OS_VERSION), options.fallback, options.distance),
        PATCH_FOR: pick_vendor(*both(PATCH_FOR), options.match),
        LINUX_TEXT: pick_dated(*both(LINUX_TEXT)),
    }
    parts = [df.withColumn("lookup", F.lit(lookup)) for lookup, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _documents(releases: DataFrame) -> DataFrame:
    """What answers show of a release."""
    return releases.select(
        F.col("pos"),
        *[
            release_column(releases, c).alias(f"doc_{c}")
            for c in (
                "id", "version_id", "version_number", "brand", "name",
                "license", "notes", "release_date", "tags", "url",
            )
        ],
    )


def format_evidence(
    found: DataFrame, releases: DataFrame | Snapshot, work_folder: str | None = None
) -> DataFrame:
    """Answer columns for each request, null where there is no release. Of a store, just the
    ranges of positions that were chosen are read."""
    if isinstance(releases, Snapshot):
        docs = lambda wanted: _documents(releases.releases(wanted))
    else:
        docs = _documents(releases)
    df = attach_releases(found, docs, work_folder)
    c = {name.removeprefix("doc_"): F.col(name) for name in df.columns if name.startswith("doc_")}
    lookup, has_doc = F.col("lookup"), F.col("pos").isNotNull()
    main = (
        F.when(lookup == PATCH_FOR, fmt.vendor_patch_version(c["version_number"], c["tags"]))
        .when(lookup == LINUX_TEXT, fmt.feed_patch_version(c["version_number"], c["tags"]))
        .otherwise(fmt.os_version(c["version_number"]))
    )
    df = df.withColumn("main", F.when(has_doc, main))
    answer = F.when(
        lookup == OS_VERSION, fmt.os_answer(F.col("main"), c["notes"], c["license"])
    ).otherwise(fmt.patch_answer(F.col("main"), c["url"], c["notes"]))
    verified = has_doc & (
        (lookup != LINUX_TEXT)
        | mentions_vendor(F.col("key"), c["tags"], c["name"], c["brand"])
    )
    blank = F.lit("")
    notes = F.when(lookup == PATCH_FOR, c["notes"]).otherwise(F.coalesce(c["notes"], blank))
    url = F.when(lookup == PATCH_FOR, c["url"]).when(
        lookup == LINUX_TEXT, F.coalesce(c["url"], blank)
    )
    license_ = F.when(lookup == OS_VERSION, F.coalesce(c["license"], blank))
    vendor = (
        F.when(lookup == PATCH_FOR, F.coalesce(c["name"], F.col("key")))
        .when(lookup == LINUX_TEXT, F.coalesce(c["name"], F.lit("Linux")))
        .otherwise(F.coalesce(c["name"], F.lit("Unknown")))
    )
    return df.select(
        *REQUEST,
        has_doc.alias("has_release"),
        verified.alias("verified"),
        "main",
        F.when(has_doc, answer).alias("text_answer"),
        F.when(has_doc, notes).alias("notes"),
        F.when(has_doc, license_).alias("license"),
        F.when(has_doc, url).alias("url"),
        F.when(has_doc, vendor).alias("doc_vendor"),
        c["id"].alias("matched_id"),
        c["version_id"].alias("matched_version_id"),
        c["release_date"].alias("matched_release_date"),
        c["tags"].alias("matched_tags"),
    )


def _reason(options: Options) -> Column:
    branch, has_release = F.col("branch"), F.coalesce(F.col("has_release"), F.lit(False))
    no_feed = F.lit("patch" in options.unavailable)
    no_corpus = F.lit("os" in options.unavailable)
    return (
        F.when((branch == PATCH_FOR) & ~F.col("vendor_in_names"), VENDOR_NOT_LISTED)
        .when(branch.isin(PATCH_FOR, LINUX_TEXT) & no_feed, FEED_ERROR)
        .when((branch == PATCH_FOR) & ~has_release, NO_TAGGED_PATCH)
        .when((branch == LINUX_TEXT) & (F.col("items_count") == 0), NO_RESULTS)
        .when((branch == LINUX_TEXT) & ~F.coalesce("verified", F.lit(False)), WRONG_VENDOR)
        .when(branch == UNKNOWN, NO_INTENT)
        .when((branch == OS_VERSION) & no_corpus, SERVER_ERROR)
        .when((branch == OS_VERSION) & ~has_release, NO_OS_MATCH)
        .otherwise(ANSWERED)
    )


def conclude(rows: DataFrame, index: DataFrame, options: Options) -> DataFrame:
    """Turn routed rows joined with their evidence into answer rows."""
    branch = F.col("branch")
    items = F.coalesce(
        *[
            F.when(
                F.col("lookup") == lookup,
                F.coalesce(corpus_size(index.where(F.col("lookup") == lookup)), F.lit(0)),
            )
            for lookup in (PATCH_FOR, LINUX_TEXT, OS_VERSION)
        ]
    )
    rows = rows.withColumn("items_count", items).withColumn("reason", _reason(options))
    status = (
        F.when(F.col("reason") == ANSWERED, "answer")
        .when(F.col("reason") == SERVER_ERROR, "error")
        .otherwise("abstain")
    )
    rows = rows.withColumn("status", status)
    answered, failed = F.col("status") == "answer", F.col("status") == "error"
    no_match = F.col("reason") == NO_OS_MATCH

    answer = (
        F.when(answered, F.col("text_answer"))
        .when(failed, "")
        .when(no_match, fmt.NO_RELEASE)
        .otherwise(fmt.DONT_KNOW)
    )
    version = F.when(answered, F.col("main")).when(no_match, fmt.NOT_AVAILABLE)
    vendor = (
        F.when(answered, F.col("doc_vendor"))
        .when(failed, None)
        .when(branch.isin(PATCH_FOR, LINUX_TEXT), F.col("key"))
        .otherwise("Unknown")
    )
    source_url = F.when(F.col("reason") == VENDOR_NOT_LISTED, options.names_source).otherwise(
        F.when(branch == PATCH_FOR, options.feed_source).when(
            branch == LINUX_TEXT, options.linux_source
        )
    )
    logged_vendor = (
        F.when(failed, UNKNOWN)
        .when(branch.isin(PATCH_FOR, LINUX_TEXT), F.col("key"))
        .when(branch == OS_VERSION, F.coalesce(F.col("vendor_name"), F.lit(DEFAULT_PRODUCT)))
        .otherwise(UNKNOWN)
    )
    none = F.array().cast("array<string>")
    shown_tags = F.when(
        answered & (branch == PATCH_FOR), F.coalesce(F.col("matched_tags"), none)
    ).when(answered | (F.col("reason") == WRONG_VENDOR), F.col("matched_tags"))
    return rows.withColumn("answer", answer).select(
        "*",
        version.alias("version"),
        vendor.alias("vendor"),
        F.when(~failed, options.source).alias("source"),
        source_url.alias("source_url"),
        shown_tags.alias("search_tags"),
        F.when(branch.isin(PATCH_FOR, LINUX_TEXT), F.col("key")).alias("asked_vendor"),
        F.when(branch == OS_VERSION, F.col("key")).alias("product"),
        fmt.preview(F.col("answer")).alias("answer_preview"),
        logged_vendor.alias("logged_vendor"),
    )


ANSWER_COLUMNS = [
    "question_id", "text", "branch", "flow", "status", "reason", "answer", "version",
    "notes", "license", "url", "vendor", "source", "source_url", "search_tags",
    "is_vendor_found", "asked_vendor", "parsed_date", "product", "items_count",
    "matched_id", "matched_version_id", "matched_release_date", "matched_tags",
    "answer_preview", "logged_vendor",
]


def answer_questions(
    questions: DataFrame,
    releases: DataFrame | Snapshot,
    vendor_names: DataFrame,
    options: Options = Options(),
    keep: tuple[str, ...] = (),
    index: DataFrame | None = None,
    work_folder: str | None = None,
) -> DataFrame:
    """One answer row per question. ``keep`` names question columns to carry along; ``index``
    is one built beforehand with the same releases and options; ``work_folder`` is where
    staged tables are overwritten instead of written anew. Releases may be a version of a
    :func:`release_store` with these options, which has its index."""
    routed = route_texts(questions, vendor_names, options, work_folder)
    routed = stage(routed.drop("normalized"), "routed", work_folder)
    requests = routed.where(F.col("lookup").isNotNull()).select(*REQUEST).distinct()
    if index is None and isinstance(releases, Snapshot):
        index = releases.index()
    elif index is None:
        index = build_index(releases, options, requests, work_folder)
    found = find_evidence(requests, index, options)
    evidence = stage(format_evidence(found, releases, work_folder), "evidence", work_folder)
    rows = (
        with_texts(questions, *keep)
        .join(join_side(routed), "text_key", "left")
        .join(join_side(evidence), REQUEST, "left")
    )
    return conclude(rows, index, options).select(*ANSWER_COLUMNS, *keep)
