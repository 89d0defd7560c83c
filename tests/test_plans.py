"""Shapes the physical plans must keep."""

import re

from plumbline.operators import lookups, summary
from plumbline.operators.questions import distinct_texts
from plumbline.operators.summary import SummaryFilter
from plumbline.operators.vendors import resolve_vendor
from workload import views
from workload.queries import all_queries

SF = "/root/testdata/sf0.001"

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_library_never_pairs(spark, monkeypatch):
    """Staged plans too: every frame written on the way is inspected."""
    from plumbline.operators import index, staging
    from plumbline.plans import answer, explain
    from plumbline.plans import summary as dashboard

    seen, write = [], staging.stage

    def watched(df, *args):
        seen.append(plan(df))
        return write(df, *args)

    for module in (index, answer, explain, dashboard, lookups):
        monkeypatch.setattr(module, "stage", watched)
    for name in ("answer_questions", "explain_with_matches", "month_summary"):
        all_queries()[name](spark, SF)
    assert len(seen) >= 9
    for text in seen:
        assert "Cartesian" not in text and "NestedLoop" not in text and "Python" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    log = views.table(spark, SF, "events").withColumnRenamed("event_id", "pos")
    log = log.selectExpr("pos", "cast(ts as timestamp) ts", "event_type as status", "value")
    path = str(tmp_path / "log")
    log.write.parquet(path)
    kept = summary.filter_events(
        spark.read.parquet(path), SummaryFilter(views.AS_OF, 7, status="error")
    ).select("pos")
    text = plan(kept)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,2024-01-24", text)
    assert "EqualTo(status,error)" in text and "value" not in text.split("ReadSchema")[1]


def test_resolving_texts_shuffles_them_once(spark):
    """The texts' grouping is reused by the grouping of their hits."""
    texts = distinct_texts(views.questions(spark, SF))
    text = plan(resolve_vendor(texts, views.vendor_names(spark, SF)))
    assert len(re.findall(r"Exchange hashpartitioning\(text_key", text)) == 1


def test_last_entries_limits_before_the_shuffle(spark):
    text = plan(summary.last_entries(views.questions(spark, SF)))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_top_lists_need_no_global_sort(spark):
    text = plan(summary.top_vendors(views.answer_events(spark, SF)))
    assert "TakeOrderedAndProject" in text


def test_questions_are_read_once_to_be_parsed(spark):
    from plumbline.operators.questions import add_vendors, parse

    texts = parse(distinct_texts(views.questions(spark, SF)))
    routed = add_vendors(texts.withColumnRenamed("text", "raw"), views.vendor_names(spark, SF))
    routed.collect()
    final = plan(routed).split("Initial Plan")[0]
    assert len(re.findall(r"FileScan parquet \[event_id", final)) == 1
    assert "ReusedExchange" in final


def test_a_hot_text_and_a_hot_request_are_split(spark, monkeypatch):
    """A third of all rows ask the same. With every join shuffled and partitions counted as
    large from a few kilobytes on, adaptive execution splits the hot ones."""
    from plumbline import answer_questions
    from plumbline.operators import staging

    hot = "case when id % 3 = 0 then 'latest linux patch' else concat('patch for linux ', id) end"
    asked = spark.range(0, 60_000, 1, 8).selectExpr("id as question_id", f"{hot} as question")
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 0)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = answer_questions(asked, views.releases(spark, SF), views.vendor_names(spark, SF))
        assert len(rows.collect()) == 60_000
        assert plan(rows).count("SortMergeJoin(skew=true)") == 2
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_index_reads_the_releases_once_and_folds_by_hashing(spark, monkeypatch):
    from plumbline.operators import index
    from plumbline.plans.answer import build_index

    seen, write = [], index.stage

    def watched(df, *args):
        seen.append(plan(df))
        return write(df, *args)

    monkeypatch.setattr(index, "stage", watched)
    build_index(views.releases(spark, SF))
    assert seen[0].count("FileScan parquet [o_orderkey") == 1
    assert "HashAggregate" in seen[0] and "SortAggregate" not in seen[0]


def test_tags_inside_vendors_meet_the_index_by_tag_and_date(spark):
    text = plan(all_queries()["patch_by_free_text_vendor"](spark, SF))
    assert re.search(r"Join \[key#\d+, rule#\d+, on#\d+\]", text)


def test_texts_to_be_staged_are_folded_by_hashing(spark):
    from plumbline.operators.questions import folded_texts

    text = plan(folded_texts(views.questions(spark, SF)))
    assert "HashAggregate" in text and "SortAggregate" not in text
