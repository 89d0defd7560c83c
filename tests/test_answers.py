import pytest
from pyspark.sql import functions as F

from plumbline import Options, answer_questions, display_answers
from plumbline.functions.formatting import DONT_KNOW, NO_RELEASE
from plumbline.operators.events import answers_to_events, last_prompts, normalize_events
from plumbline.plans.component import component_snapshot
from plumbline.plans.explain import explain_matches, explain_questions
from workload.queries import all_queries


@pytest.fixture(scope="module")
def corpus(releases):
    return releases(
        {
            "pos": 3,
            "name": "Android",
            "version_number": "16.0.0",
            "channel": "production",
            "release_date": "2025[29]0213",
            "ts_ms": 1740363996589,
            "tags": ["os", "android", "production", "2025[29]0213", "16.0.0"],
            "notes": "https://example.com/android",
            "license": "Apache 2.0",
        },
        {
            "pos": 7,
            "name": "Linux",
            "version_number": "1.1.1",
            "release_date": "20260214",
            "ts_ms": 1771087524592,
            "tags": ["linux", "patch", "20260214", "1.1.2"],
            "notes": "n" * 201,
            "url": "https://example.com/linux",
        },
        {"pos": 9, "name": "Flutter", "channel": "beta", "tags": ["flutter"], "notes": ""},
    )


def answers(questions, releases, names, **options):
    rows = answer_questions(questions, releases, names, Options(**options)).collect()
    return {r["text"]: r for r in rows}


def test_answers_and_reasons(ask, corpus, names):
    got = answers(
        ask(
            "patch for Linux on 02-14-2026",
            "linux patch of 2/14/2026",
            "patch for Roblox",
            "patch for Ubuntu",
            "Android version",
            "hello",
            "Flutter on 1/1/2020",
            "Windows version",
            "patch for Linux on 02-14-2026",
        ),
        corpus,
        names("Linux", "Android", "Ubuntu", "Flutter"),
    )
    row = got["patch for Linux on 02-14-2026"]
    assert row["version"] == "1.1.1" and row["status"] == "answer" and row["license"] is None
    assert row["answer"] == (
        "Patch version: 1.1.1\nURL: https://example.com/linux\nRelease notes: " + "n" * 200 + "…"
    )
    row = got["linux patch of 2/14/2026"]
    assert (row["version"], row["vendor"], row["items_count"]) == ("1.1.2", "Linux", 1)
    row = got["patch for Roblox"]
    assert (row["reason"], row["vendor"], row["is_vendor_found"]) == (
        "patch_vendor_not_in_names", "roblox", 0,
    )
    assert row["answer"] == DONT_KNOW and row["version"] is None
    assert got["patch for Ubuntu"]["reason"] == "patch_not_found_in_search_tags"
    row = got["Android version"]
    assert row["answer"] == (
        "Version: 16.0.0. Release notes: https://example.com/android. License: Apache 2.0."
    )
    assert row["logged_vendor"] == "Android" and row["url"] is None and row["product"] == "android"
    assert got["hello"]["reason"] == "unknown_intent_not_patch_or_os_version"
    assert got["Flutter on 1/1/2020"]["answer"] == "Version: . Release notes: N/A. License: N/A."
    assert got["Windows version"]["matched_id"] == "d0"  # unlisted: the default product


def test_unknown_product_falls_back_to_the_first_release(ask, corpus, names):
    asked, listed = ask("Zebra version"), names("Zebra")
    assert answers(asked, corpus, listed)["Zebra version"]["matched_id"] == "d0"
    row = answers(asked, corpus, listed, fallback="none")["Zebra version"]
    assert (row["reason"], row["answer"], row["version"], row["vendor"]) == (
        "os_no_match", NO_RELEASE, "N/A", "Unknown",
    )


def test_empty_corpus(ask, corpus, names):
    got = answers(
        ask("linux news", "patch for linux", "android version"),
        corpus.where("false"),
        names("Linux"),
    )
    assert {t: r["reason"] for t, r in got.items()} == {
        "linux news": "no_results",
        "patch for linux": "patch_not_found_in_search_tags",
        "android version": "os_no_match",
    }


def test_picked_release_must_name_the_vendor(ask, releases, names, monkeypatch):
    """A feed searched elsewhere may hold releases of another vendor."""
    import plumbline.plans.answer as plan

    docs = releases({"name": "Other", "tags": ["other", "patch"], "release_date": ""})
    every = dict.fromkeys((plan.OS_VERSION, plan.PATCH_FOR, plan.LINUX_TEXT), F.lit(True))
    monkeypatch.setattr(plan, "_conditions", lambda r, o: every)
    row = answers(ask("linux 1/1/2026"), docs, names("Linux"))["linux 1/1/2026"]
    assert row["reason"] == "versionSearchTags_does_not_have_provided_vendor"
    assert row["status"] == "abstain" and row["search_tags"] == ["other", "patch"]


def test_unreadable_sources(ask, corpus, names):
    asked = ask("linux news", "patch for linux", "android version", "patch for zzz")
    got = answers(asked, corpus, names("Linux"), unavailable=frozenset({"patch", "os"}))
    assert {t: (r["status"], r["reason"]) for t, r in got.items()} == {
        "linux news": ("abstain", "patch_api_error"),
        "patch for linux": ("abstain", "patch_api_error"),
        "patch for zzz": ("abstain", "patch_vendor_not_in_names"),
        "android version": ("error", "server_error"),
    }
    failed = got["android version"]
    assert failed["answer"] == "" and (failed["flow"], failed["logged_vendor"]) == ("os", "unknown")


def test_component_type(ask, releases, names):
    docs = releases({"name": "Android", "ts_ms": 9}, {"name": "Android", "ts_ms": 1})
    docs = docs.withColumn("product_type", F.when(F.col("pos") == 1, "OS").otherwise(""))
    asked, listed = ask("Android version"), names("Android")
    assert answers(asked, docs, listed)["Android version"]["matched_id"] == "d0"
    row = answers(asked, docs, listed, component_type="os")["Android version"]
    assert (row["matched_id"], row["items_count"]) == ("d1", 1)


def test_no_vendor_list(ask, corpus, names):
    got = answers(ask("patch for linux", "android version"), corpus, names("x").where("false"))
    assert got["patch for linux"]["reason"] == "patch_vendor_not_in_names"
    assert got["android version"]["status"] == "answer"


def test_version_precedence_and_missing_tags(ask, releases, names):
    docs = releases(
        {"name": "linux", "version_number": None, "tags": ["linux", "patch", "3"], "ts_ms": 2},
        {"name": "linux", "version_number": "2", "tags": None, "ts_ms": 9},
    )
    got = answers(ask("patch for linux", "linux news"), docs, names("Linux"))
    assert got["patch for linux"]["version"] == "3"
    assert got["linux news"]["version"] == "2" and got["linux news"]["search_tags"] is None


def test_without_any_broadcast(spark, monkeypatch):
    """Past the bounds every join shuffles; the answers stay the same."""
    from plumbline.operators import staging
    from workload import views

    sf = "/root/testdata/sf0.001"
    asked, docs, listed = (f(spark, sf) for f in (views.questions, views.releases, views.vendor_names))
    usual = answer_questions(asked, docs, listed).collect()
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = answer_questions(asked, docs, listed)
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(rows.collect()) == sorted(usual)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_events_of_answers(ask, corpus, names):
    rows = answer_questions(ask("android version", "hello"), corpus, names("Linux"))
    events = answers_to_events(rows.withColumn("at", F.timestamp_millis(F.lit(5))), "at")
    got = {tuple(r)[2:] for r in events.collect()}
    assert got == {
        ("answer", "os", "android", None, "answered", 0),
        ("abstain", "unknown", "unknown", None, "unknown_intent_not_patch_or_os_version", 0),
    }


def test_event_defaults(spark):
    rows = spark.createDataFrame(
        [(0, "", None, "", float("inf"), "", 7), (1, "a", "b", " ", 5.0, "r", 0)],
        "pos long, status string, flow string, vendor string, latency_ms double, reason string, "
        "is_vendor_found int",
    ).withColumn("ts", F.timestamp_millis(F.lit(0)))
    got = [tuple(r)[2:] for r in normalize_events(rows).orderBy("pos").collect()]
    assert got == [("unknown", "unknown", "unknown", None, None, None), ("a", "b", " ", 5, "r", 0)]


def test_last_prompts_skip_blanks(spark):
    rows = spark.createDataFrame(
        [(1, 5, "a"), (2, 5, "b"), (3, 9, "  "), (4, 1, "c"), (5, 2, "d")],
        "question_id long, at long, question string",
    ).withColumn("asked_at", F.timestamp_seconds("at"))
    assert [r["prompt"] for r in last_prompts(rows).collect()] == ["b", "a", "d"]


def test_display(spark):
    rows = spark.createDataFrame(
        [
            ("Patch version: 1\nURL: u\n\nRelease Note : n\nmore", "1", "u", "http://n"),
            ("Version: 1. x", "", "", "n"),
            (None, None, None, None),
        ],
        "answer string, version string, url string, notes string",
    )
    got = [tuple(r)[4:] for r in display_answers(rows).collect()]
    assert got == [
        ("more", "1", True),
        ("Version: 1. x", "Version: 1. x", False),
        ("", "", False),
    ]


def test_explain(ask, corpus):
    rows = {r["raw_question"]: r for r in explain_questions(
        ask("patch for X", "patch for linux", "my linux", "linux on android", "ios", "windows", "")
    ).collect()}
    assert rows["patch for X"]["branch"] == "patch_non_linux → idk"
    assert {t for t, r in rows.items() if r["branch"] == "patch_linux"} == {"patch for linux", "my linux"}
    products = {t: r["product"] for t, r in rows.items() if r["branch"] == "os"}
    assert products == {
        "linux on android": "android", "ios": "ios", "windows": "windows", None: "android",
    }
    matched = {r["question_id"]: r for r in explain_matches(ask("my linux", "ios"), corpus).collect()}
    assert matched[0]["matched_has_vendor"] and matched[0]["items_count"] == 1
    assert matched[1]["matched_name"] == "Android" and matched[1]["items_count"] == 3


def test_component(corpus):
    row = component_snapshot(corpus).first()
    assert (row["main"], row["last_value"], row["components_count"]) == ("16.0.0", "0", 3)
    assert component_snapshot(corpus, "apps").first()["error"] == "Only q=os is supported"


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 1000
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(all_queries()) <= set(contract.queries())
