"""One query per operator. Each reads the generated tables in full and returns flat columns."""

from __future__ import annotations

import datetime as dt
import functools
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import formatting as fmt
from plumbline.functions.dates import date_digits, unbracketed
from plumbline.operators import events as ev
from plumbline.operators import lookups, questions, releases, summary, vendors
from plumbline.operators.percentiles import approximate_percentiles, exact_percentiles
from plumbline.operators.staging import new_folder
from plumbline.operators.summary import SummaryFilter
from plumbline.plans.answer import OS_VERSION, Options, answer_questions, release_store
from plumbline.plans.component import component_snapshot, format_os
from plumbline.plans.display import display_answers
from plumbline.plans.explain import explain_matches, explain_questions
from plumbline.plans.partials import refresh_days, summary_from_days
from plumbline.plans.summary import build_summary
from plumbline.sources import event_log, landed
from plumbline.streaming.answers import answer_stream
from plumbline.streaming.days import days_stream
from plumbline.streaming.prompts import current_prompts, prompts_stream
from plumbline.streaming.rollup import (
    RANK_ERROR,
    append_stream,
    daily_rollup,
    rollup_by_day,
    rollup_percentiles,
    write_rollup,
)
from plumbline.streaming.upkeep import release_stream

from . import views
from .views import AS_OF

Query = Callable[[SparkSession, str], DataFrame]
MONTH = SummaryFilter(AS_OF, range_days=30)
FILTERED = SummaryFilter(AS_OF, range_days=7, flow="os", status="abstain", vendor=" vendor_1")

_queries: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name without the underscore that keeps it apart from
    the library function it calls. The tables hold UTC times."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ensure_folder(spark)
        return fn(spark, sf_dir)

    _queries[fn.__name__.removesuffix("_")] = run
    return run


def ensure_folder(spark: SparkSession) -> None:
    """A folder for intermediate tables, for local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.startswith("local["):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def flat(name: str):
    return F.array_join(name, "|").alias(name)


def asked(spark, sf_dir):
    return questions.with_texts(views.questions(spark, sf_dir))


def texts(spark, sf_dir):
    return questions.parse(questions.distinct_texts(views.questions(spark, sf_dir)))


# -- questions ----------------------------------------------------------------------------


@query
def parse_questions(spark, sf_dir):
    parsed = questions.parse(asked(spark, sf_dir))
    return parsed.select("question_id", "normalized", "parsed_vendor", "parsed_date")


@query
def parse_questions_day_first(spark, sf_dir):
    parsed = questions.parse(asked(spark, sf_dir), day_first=True)
    return parsed.select("question_id", "parsed_date")


@query
def route_questions(spark, sf_dir):
    named = questions.add_vendors(texts(spark, sf_dir), views.vendor_names(spark, sf_dir))
    return questions.route(named).select("text", "branch", "flow", "is_vendor_found")


@query
def route_questions_strict(spark, sf_dir):
    """Whole-word vendors; a repeated character is no question."""
    named = questions.add_vendors(
        texts(spark, sf_dir), views.vendor_names(spark, sf_dir), boundary=True
    )
    return questions.route(named, strict=True).select("text", "branch", "vendor_name")


@query
def resolve_vendor(spark, sf_dir):
    """The vendor of every question, not only of every text."""
    once = questions.distinct_texts(views.questions(spark, sf_dir))
    named = vendors.resolve_vendor(once, views.vendor_names(spark, sf_dir))
    return asked(spark, sf_dir).join(named, "text_key", "left").select("question_id", "vendor_name")


@query
def resolve_vendor_in_documents(spark, sf_dir):
    """Source and language names occurring anywhere in the long documents."""
    docs = views.table(spark, sf_dir, "documents")
    words = docs.select(F.explode(F.array("source", "lang")).alias("name")).distinct()
    listed = words.select(F.length("name").cast("bigint").alias("pos"), "name")
    return vendors.resolve_vendor(docs, listed, key="doc_id")


@query
def vendor_in_names(spark, sf_dir):
    return vendors.vendors_in_names(
        texts(spark, sf_dir), "parsed_vendor", views.vendor_names(spark, sf_dir)
    )


@query
def vendor_found_flag(spark, sf_dir):
    flags = questions.add_vendors(texts(spark, sf_dir), views.vendor_names(spark, sf_dir))
    return (
        asked(spark, sf_dir)
        .join(flags.select("text_key", "is_vendor_found"), "text_key", "left")
        .select("question_id", "is_vendor_found")
    )


@query
def list_vendors(spark, sf_dir):
    return landed.list_vendors(views.vendor_names(spark, sf_dir), limit=100)


@query
def vendor_list_fallback(spark, sf_dir):
    """An empty primary list is replaced, a filled one is kept."""
    names = views.vendor_names(spark, sf_dir)
    empty = names.where("name is null")
    kept = landed.first_filled(names, names.withColumn("name", F.lower("name")))
    return landed.first_filled(empty, kept).select("pos", "name")


@query
def vendor_snapshot(spark, sf_dir):
    """Of one snapshot per order day, the newest list."""
    rows = views.releases(spark, sf_dir).select("pos", "name", F.col("ts_ms").alias("snapshot_ts"))
    return landed.latest_snapshot(rows)


# -- lookups ------------------------------------------------------------------------------


@query
def release_by_product_date(spark, sf_dir):
    return lookups.product_release(views.requests(spark, sf_dir), views.releases(spark, sf_dir))


@query
def release_by_known_product(spark, sf_dir):
    return lookups.product_release(
        views.requests(spark, sf_dir), views.releases(spark, sf_dir), fallback="none"
    )


@query
def release_by_calendar_date(spark, sf_dir):
    """Nearest by days, bracketed dates repaired."""
    docs = views.releases(spark, sf_dir).withColumn("release_date", unbracketed(F.col("release_date")))
    return lookups.product_release(views.requests(spark, sf_dir), docs, distance="days")


@query
def latest_release(spark, sf_dir):
    docs = views.releases(spark, sf_dir)
    found = lookups.attach_releases(lookups.latest_per_product(docs), docs)
    return found.select("key", "pos", "version_number", "release_date")


@query
def patch_by_vendor_date(spark, sf_dir):
    feed = releases.patch_feed(views.releases(spark, sf_dir))
    return lookups.vendor_patch(views.requests(spark, sf_dir), feed)


@query
def patch_by_free_text_vendor(spark, sf_dir):
    """Hundreds of vendors that hold one tag, each asking for dates of its own."""
    feed = releases.patch_feed(views.releases(spark, sf_dir))
    return lookups.vendor_patch(views.free_requests(spark, sf_dir), feed)


@query
def patch_by_vendor_date_any_field(spark, sf_dir):
    return lookups.vendor_patch(
        views.requests(spark, sf_dir), views.releases(spark, sf_dir), match="any_field"
    )


@query
def vendor_patch_cve_counts(spark, sf_dir):
    return releases.patch_and_cve_counts(views.releases(spark, sf_dir))


@query
def cve_by_vendor(spark, sf_dir):
    feed = releases.cve_feed(views.releases(spark, sf_dir))
    return lookups.vendor_patch(views.requests(spark, sf_dir), feed)


@query
def linux_style_patch_by_date(spark, sf_dir):
    feed = releases.vendor_feed(views.releases(spark, sf_dir), "Linux")
    found = lookups.dated_patch(views.requests(spark, sf_dir), feed)
    return lookups.attach_releases(found, feed).select("key", "date", "pos", "release_date")


@query
def normalize_release_dates(spark, sf_dir):
    return views.releases(spark, sf_dir).select(
        "pos", "release_date", date_digits(F.col("release_date")).alias("date_norm")
    )


@query
def search_releases(spark, sf_dir):
    found = releases.search_releases(views.releases(spark, sf_dir), vendor="nation_1", channel="patch")
    return found.select("pos", "name", "release_date", flat("tags"))


@query
def search_releases_page(spark, sf_dir):
    found = releases.search_releases(
        views.releases(spark, sf_dir), channel="patch", limit=25, page=2
    )
    return found.select("pos", "name", "ts_ms")


@query
def component_snapshot_(spark, sf_dir):
    return component_snapshot(views.releases(spark, sf_dir)).withColumn(
        "tags", F.array_join("tags", "|")
    )


# -- a store of releases -------------------------------------------------------------------

STRAY = 10**8  # positions of releases that are taken out again


def outdated(docs):
    """Releases as they were before: a third is not there yet, some are about other products and
    days, some will be removed."""
    early = docs.where("pos % 3 <> 0")
    other = F.col("pos") % 5 == 1
    tags = F.array(F.lit("linux"), F.lit("patch"), F.lit("20200101"))
    changed = {"name": F.lit("Linux"), "release_date": F.lit("20200101"), "tags": tags, "ts_ms": F.col("ts_ms") * 2}
    early = early.withColumns({c: F.when(other, v).otherwise(F.col(c)) for c, v in changed.items()})
    return early.unionByName(docs.where("pos % 4 = 2").withColumn("pos", F.col("pos") + STRAY))


def kept_up(spark, sf_dir):
    """A store that has come to hold the releases by three changes."""
    docs = views.releases(spark, sf_dir)
    before = outdated(docs)
    store = release_store(spark, new_folder(spark, "releases"), span=100_000, buckets=16)
    store.apply(before)
    store.apply(docs.where("pos % 3 = 0"))
    store.apply(docs.where("pos % 3 <> 0 and pos % 5 = 1"), before.where(F.col("pos") >= STRAY).select("pos"))
    return store


@query
def release_by_product_date_kept_up(spark, sf_dir):
    index = kept_up(spark, sf_dir).snapshot().index().where(F.col("lookup") == OS_VERSION)
    return lookups.pick_product(views.requests(spark, sf_dir), index.drop("lookup"))


@query
def answer_questions_kept_up(spark, sf_dir):
    snapshot = kept_up(spark, sf_dir).snapshot()
    return flat_answers(
        answer_questions(views.questions(spark, sf_dir), snapshot, views.vendor_names(spark, sf_dir))
    )


# -- answers ------------------------------------------------------------------------------


@query
def format_patch(spark, sf_dir):
    number, tags, url, notes = F.col("version_number"), F.col("tags"), F.col("url"), F.col("notes")
    asked, fed = fmt.vendor_patch_version(number, tags), fmt.feed_patch_version(number, tags)
    return releases.patch_feed(views.releases(spark, sf_dir)).select(
        "pos",
        asked.alias("version"),
        fed.alias("feed_version"),
        fmt.patch_answer(asked, url, notes).alias("answer"),
        fmt.patch_answer(fed, url, notes).alias("feed_answer"),
    )


@query
def format_os_(spark, sf_dir):
    rows = format_os(views.releases(spark, sf_dir))
    answer = fmt.os_answer(F.col("main"), F.col("notes"), F.col("license"))
    return rows.select(
        "pos", "main", "last_value", answer.alias("answer"), fmt.preview(answer).alias("preview")
    )


def answers(spark, sf_dir, options=Options(), keep=()):
    return answer_questions(
        views.questions(spark, sf_dir),
        views.releases(spark, sf_dir),
        views.vendor_names(spark, sf_dir),
        options,
        keep,
    )


def flat_answers(df):
    return df.withColumns(
        {c: F.array_join(c, "|") for c in ("search_tags", "matched_tags")}
    )


@query
def answer_questions_(spark, sf_dir):
    return flat_answers(answers(spark, sf_dir))


@query
def answer_questions_strict(spark, sf_dir):
    """The documented intent: no first release for an unknown product, whole-word vendors,
    day before month, any-field patches."""
    options = Options(
        fallback="none", boundary=True, strict=True, day_first=True, match="any_field"
    )
    return answers(spark, sf_dir, options).select(
        "question_id", "branch", "status", "reason", "version", "matched_id"
    )


@query
def answer_questions_by_type(spark, sf_dir):
    """Version questions are answered from operating systems alone, though patches share their
    table."""
    kind = F.when(F.col("channel") == "patch", "patch").otherwise("OS")
    return answer_questions(
        views.questions(spark, sf_dir),
        views.releases(spark, sf_dir).withColumn("product_type", kind),
        views.vendor_names(spark, sf_dir),
        Options(component_type="os"),
    ).select("question_id", "branch", "status", "reason", "version", "items_count", "matched_id")


@query
def answer_questions_first_page(spark, sf_dir):
    """Evidence limited to the newest 25 patches of each feed."""
    return answers(spark, sf_dir, Options(evidence_limit=25)).select(
        "question_id", "status", "reason", "items_count", "matched_id"
    )


@query
def answer_without_sources(spark, sf_dir):
    """Both release sources unreadable."""
    options = Options(unavailable=frozenset({"patch", "os"}))
    return answers(spark, sf_dir, options).select(
        "question_id", "flow", "status", "reason", "answer", "version", "vendor", "logged_vendor"
    )


@query
def explain_questions_(spark, sf_dir):
    return explain_questions(views.questions(spark, sf_dir))


@query
def explain_with_matches(spark, sf_dir):
    rows = explain_matches(views.questions(spark, sf_dir), views.releases(spark, sf_dir))
    return rows.select(
        "question_id", "branch", "product", "items_count", "first_item_name",
        flat("first_item_tags"), "matched_has_vendor", "matched_name", "matched_release_date",
        flat("matched_tags"),
    )


@query
def clean_answer_text(spark, sf_dir):
    shown = display_answers(answers(spark, sf_dir))
    return shown.select("question_id", "clean_answer", "shown_answer", "notes_is_link")


@query
def answers_to_events(spark, sf_dir):
    rows = answers(spark, sf_dir, keep=("asked_at", "user_id"))
    events = ev.answers_to_events(rows, "asked_at", "user_id")
    return events.withColumn("ts", F.unix_millis("ts"))


# -- ask log ------------------------------------------------------------------------------


def month(spark, sf_dir):
    return summary.filter_events(views.answer_events(spark, sf_dir), MONTH)


@query
def summary_counts(spark, sf_dir):
    return summary.summary_counts(month(spark, sf_dir))


@query
def summary_latency(spark, sf_dir):
    """Exact p50, p95 and mean per flow."""
    events = month(spark, sf_dir)
    ranks = exact_percentiles(events, "latency_ms", {"p50": 50, "p95": 95}, ("flow",))
    counts = summary.with_rates(events.groupBy("flow").agg(*summary.count_columns()))
    return counts.join(ranks, "flow", "left").select("flow", "p50", "p95", "latency_mean")


@query
def top_vendors(spark, sf_dir):
    return summary.top_vendors(month(spark, sf_dir))


@query
def top_reasons(spark, sf_dir):
    return summary.top_reasons(month(spark, sf_dir))


@query
def daily_counts(spark, sf_dir):
    """Twice the logged month, so that half the days are filled with zero."""
    wide = SummaryFilter(AS_OF, range_days=60)
    events = summary.filter_events(views.answer_events(spark, sf_dir), wide)
    return summary.daily_counts(events, wide)


@query
def bar_scale(spark, sf_dir):
    return summary.bar_widths(summary.top_vendors(month(spark, sf_dir))).select(
        "vendor", "count", "max_count", "width"
    )


@query
def kpi_breakdown(spark, sf_dir):
    return summary.kpi_breakdown(month(spark, sf_dir))


@query
def recent_events(spark, sf_dir):
    rows = summary.recent_events(month(spark, sf_dir))
    return rows.withColumn("ts", F.unix_millis("ts"))


@query
def last_prompts(spark, sf_dir):
    rows = ev.last_prompts(views.questions(spark, sf_dir))
    return rows.withColumn("asked_at", F.unix_millis("asked_at"))


@query
def last_chat_entries(spark, sf_dir):
    rows = summary.last_entries(views.questions(spark, sf_dir))
    return rows.select("user_id", "recency", "question_id", "question")


@query
def retain_last(spark, sf_dir):
    events = ev.retain_last(views.answer_events(spark, sf_dir), 5000)
    return events.select("pos", "status", "vendor")


@query
def today_top_vendors(spark, sf_dir):
    """Among the twelve newest events, as a dashboard lists them."""
    return summary.today_top_vendors(views.answer_events(spark, sf_dir), AS_OF, recent=summary.RECENT)


@query
def day_top_vendors(spark, sf_dir):
    """The same over the day's whole log."""
    return summary.today_top_vendors(views.answer_events(spark, sf_dir), AS_OF)


def _pairs(name, label):
    return F.array_join(
        F.transform(name, lambda x: F.concat(x[label], F.lit("="), x["count"].cast("string"))), "|"
    ).alias(name)


def flat_summary(df):
    recent = F.transform(
        "recent", lambda e: F.concat_ws(":", e["ts"].cast("string"), e["status"], e["vendor"])
    )
    return df.select(
        "range_days", "day_from", "day_to",
        F.col("filters.flow").alias("flow"),
        F.col("filters.status").alias("status"),
        F.col("filters.vendor").alias("vendor"),
        "total_questions", "answered_count", "abstain_count", "error_count",
        "abstain_rate", "answer_rate",
        "latency_ms.p50", "latency_ms.p95", F.col("latency_ms.average").alias("average"),
        _pairs("top_vendors", "vendor"),
        _pairs("top_reasons", "reason"),
        _pairs("time_buckets", "day"),
        "max_vendor_count", "max_day_count", "vendor_not_found_count",
        "os_version_query_count", "patch_query_count",
        F.array_join(recent, "|").alias("recent"),
    )


@query
def month_summary(spark, sf_dir):
    return flat_summary(build_summary(views.answer_events(spark, sf_dir), MONTH))


@query
def filtered_summary(spark, sf_dir):
    return flat_summary(build_summary(views.answer_events(spark, sf_dir), FILTERED))


def stored_days(spark, sf_dir):
    """Cells of all days, of which the newest was first stored too early, with a part of its events."""
    log, path = views.answer_events(spark, sf_dir), new_folder(spark, "days")
    days = [AS_OF - dt.timedelta(days=n) for n in range(31)]
    early = log.where((F.to_date("ts") < F.lit(AS_OF)) | (F.col("pos") % 3 == 0))
    refresh_days(early, path, days)
    refresh_days(log, path, days[:1])
    return path


@query
def month_summary_from_days(spark, sf_dir):
    return flat_summary(summary_from_days(spark, stored_days(spark, sf_dir), MONTH))


@query
def filtered_summary_from_days(spark, sf_dir):
    return flat_summary(summary_from_days(spark, stored_days(spark, sf_dir), FILTERED))


@query
def month_latency_from_rollup(spark, sf_dir):
    """Percentiles merged from the sketches of a rollup. What is returned is how many values they are
    of, and whether their ranks among the logged latencies are within the bound."""
    events, path = views.answer_events(spark, sf_dir), new_folder(spark, "sketched-rollup")
    daily_rollup(events, sketch=True).write.parquet(path)
    percents = {"p50": 50, "p95": 95}
    found = rollup_percentiles(spark.read.parquet(path), percents, MONTH.day_from, MONTH.as_of)
    logged = summary.filter_events(events, MONTH).where("latency_ms is not null")
    n, rows = F.count(F.lit(1)), []
    for name, p in percents.items():
        value = found.select(name).scalar()
        low, high = F.count_if(F.col("latency_ms") < value), F.count_if(F.col("latency_ms") <= value)
        near = (low <= (p / 100 + RANK_ERROR) * n) & (high >= (p / 100 - RANK_ERROR) * n)
        same = n == found.select("n").scalar()
        rows.append(F.struct(F.lit(p).alias("percent"), n.alias("n"), (near & same).alias("within_bound")))
    return logged.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


@query
def approximate_latency(spark, sf_dir):
    """The one-pass percentiles, by flow; latencies have fewer values than the sketch has room for."""
    return approximate_percentiles(month(spark, sf_dir), "latency_ms", {"p50": 50, "p95": 95}, ("flow",))


# -- sources and streams ------------------------------------------------------------------


def _landed_columns(df):
    return df.select("pos", "id", "name", "version_number", "ts_ms", "is_cve", flat("tags"))


@query
def unwrap_envelopes(spark, sf_dir):
    return _landed_columns(landed.releases_from(views.landed_releases(spark, sf_dir)))


@query
def unwrap_patch_feed(spark, sf_dir):
    return _landed_columns(
        landed.releases_from(views.landed_releases(spark, sf_dir), landed.PATCH_FIELDS)
    )


@query
def unwrap_vendor_names(spark, sf_dir):
    return landed.vendor_names_from(views.landed_names(spark, sf_dir))


@query
def decode_events(spark, sf_dir):
    events = event_log.decode_events(views.event_lines(spark, sf_dir))
    return events.withColumn("ts", F.unix_millis("ts"))


@query
def event_log_by_day(spark, sf_dir):
    """Write the log partitioned by day, read one week back through its partitions."""
    path = new_folder(spark, "event-log")
    event_log.append_events(views.answer_events(spark, sf_dir), path)
    week = SummaryFilter(AS_OF, range_days=7)
    kept = summary.filter_events(event_log.read_events(spark, path), week)
    return kept.select("pos", F.unix_millis("ts").alias("ts"), "status", "latency_ms")


def _event_stream(spark, sf_dir):
    schema = views.table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return reader.parquet(sf_dir)


ONCE = {"availableNow": True}


@query
def stream_daily_rollup(spark, sf_dir):
    """Days the watermark has closed."""
    events = views.answer_events_from(_event_stream(spark, sf_dir))
    path = new_folder(spark, "rollup")
    write_rollup(
        daily_rollup(events), path, new_folder(spark, "rollup-checkpoint"), ONCE
    ).awaitTermination()
    return rollup_by_day(spark.read.parquet(path)).select(
        "day", "total", "answered", "abstained", "errors", "vendor_not_found",
        "abstain_rate", "answer_rate", "latency_mean",
    )


@query
def stream_daily_live(spark, sf_dir):
    """Every day, the open one included: the stream appended to the log, the log rolled up."""
    path = new_folder(spark, "live-log")
    events = views.answer_events_from(_event_stream(spark, sf_dir))
    append_stream(events, path, new_folder(spark, "live-checkpoint"), ONCE).awaitTermination()
    return rollup_by_day(daily_rollup(event_log.read_events(spark, path))).select(
        "day", "total", "answered", "abstained", "errors", "vendor_not_found",
        "abstain_rate", "answer_rate", "latency_mean",
    )


@query
def stream_event_log(spark, sf_dir):
    """The event stream appended to a log, read back whole."""
    path = new_folder(spark, "stream-log")
    events = views.answer_events_from(_event_stream(spark, sf_dir))
    append_stream(events, path, new_folder(spark, "log-checkpoint"), ONCE).awaitTermination()
    rows = event_log.read_events(spark, path)
    return rows.select("pos", F.unix_millis("ts").alias("ts"), "status", "flow", "vendor")


@query
def stream_event_log_once(spark, sf_dir):
    """A source that sends everything twice, in four micro-batches."""
    inbox, path = new_folder(spark, "event-inbox"), new_folder(spark, "once-log")
    events = views.answer_events(spark, sf_dir)
    for _ in range(2):
        events.repartition(2, "pos").write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    checkpoint = new_folder(spark, "once-checkpoint")
    append_stream(stream, path, checkpoint, ONCE, once=("pos",), watermark="60 days").awaitTermination()
    rows = event_log.read_events(spark, path)
    return rows.select("pos", F.unix_millis("ts").alias("ts"), "status", "flow", "vendor")


@query
def stream_month_summary(spark, sf_dir):
    """Stored days kept up by a stream, of which a part comes weeks late."""
    inbox, log, days = (new_folder(spark, f"late-{name}") for name in ("inbox", "log", "days"))
    events = views.answer_events(spark, sf_dir)
    late = (F.to_date("ts") < F.date_sub(F.lit(AS_OF), 7)) & (F.col("pos") % 100 == 7)
    for part in (events.where(~late), events.where(late)):
        part.coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    days_stream(stream, log, days, new_folder(spark, "late-checkpoint"), ONCE).awaitTermination()
    return flat_summary(summary_from_days(spark, days, MONTH))


@query
def stream_answers(spark, sf_dir):
    path = new_folder(spark, "answers")
    answer_stream(
        views.questions_from(_event_stream(spark, sf_dir)),
        views.releases(spark, sf_dir),
        views.vendor_names(spark, sf_dir),
        path,
        new_folder(spark, "answers-checkpoint"),
        trigger=ONCE,
    ).awaitTermination()
    return spark.read.parquet(path).select(
        "question_id", "status", "reason", "version", "vendor", "matched_id", "is_vendor_found"
    )


@query
def stream_answers_kept_up(spark, sf_dir):
    """The releases come as a stream of changes, three deliveries of as many files as they need and so
    three micro-batches, into a store that a stream of questions reads."""
    docs = views.releases(spark, sf_dir)
    before, inbox = outdated(docs), new_folder(spark, "release-inbox")
    later = docs.where("pos % 3 = 0 or pos % 5 = 1")
    removals = before.where(F.col("pos") >= STRAY).withColumn("removed", F.lit(True))
    present = F.lit(False).alias("removed")
    store = release_store(spark, new_folder(spark, "stream-releases"), span=100_000, buckets=16)
    checkpoint = new_folder(spark, "release-checkpoint")
    for rows in (before.select("*", present), later.select("*", present), removals):
        rows.write.mode("append").parquet(inbox)
        changes = spark.readStream.schema(removals.schema).parquet(inbox)
        release_stream(changes, store, checkpoint, trigger=ONCE).awaitTermination()
    path = new_folder(spark, "kept-up-answers")
    answer_stream(
        views.questions_from(_event_stream(spark, sf_dir)),
        store,
        views.vendor_names(spark, sf_dir),
        path,
        new_folder(spark, "kept-up-checkpoint"),
        trigger=ONCE,
    ).awaitTermination()
    return spark.read.parquet(path).select(
        "question_id", "status", "reason", "version", "vendor", "matched_id", "is_vendor_found"
    )


@query
def stream_answers_logged(spark, sf_dir):
    """The questions arrive in four deliveries, a micro-batch each; what their events tell. A delivery
    has a file for every core, since a file is read, and its batch answered, by few tasks."""
    inbox, path = new_folder(spark, "inbox"), new_folder(spark, "logged-answers")
    asked_ = views.questions(spark, sf_dir)
    files = spark.sparkContext.defaultParallelism
    asked_.repartition(4 * files, "question_id").write.parquet(inbox)
    stream = spark.readStream.schema(asked_.schema).option("maxFilesPerTrigger", files).parquet(inbox)
    log = new_folder(spark, "logged-events")
    answer_stream(
        stream,
        views.releases(spark, sf_dir),
        views.vendor_names(spark, sf_dir),
        path,
        new_folder(spark, "logged-checkpoint"),
        events_path=log,
        trigger=ONCE,
        refresh_every=3,
    ).awaitTermination()
    waited = F.col("latency_ms").isNotNull().alias("waited")
    return spark.read.parquet(log).select("pos", "status", "flow", "vendor", "reason", waited)


@query
def stream_last_prompts(spark, sf_dir):
    """The last prompts kept up to date batch by batch."""
    path = new_folder(spark, "last-prompts")
    prompts_stream(
        views.questions_from(_event_stream(spark, sf_dir)),
        path,
        new_folder(spark, "prompts-checkpoint"),
        trigger=ONCE,
    ).awaitTermination()
    rows = current_prompts(spark, path)
    return rows.withColumn("asked_at", F.unix_millis("asked_at"))
