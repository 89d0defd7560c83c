import hashlib

import pytest

from plumbline.operators.questions import (
    add_vendors,
    distinct_texts,
    folded_texts,
    parse,
    question_text,
    route,
)
from plumbline.operators.vendors import resolve_vendor, vendors_in_names
from pyspark.sql import functions as F

# text, vendor, date, branch (with no vendor list)
PARSES = [
    ("Which is the patch for Linux on 02-14-2026?", "linux", "20260214", "patch_for"),
    ("patch for Linux on 14-02-2026", "linux", "20261402", "patch_for"),
    ("patch for linux", "linux", None, "patch_for"),
    ("newest Linux patch", None, None, "linux_text"),
    ("Linux patch of 2/2/2026", None, "20260202", "linux_text"),
    ("Linux patch for 15-03-2026", "15-03-2026", "20261503", "patch_for"),
    ("patch for linux, on 01-02-2026", None, "20260102", "linux_text"),
    ("patch for linux on", "linux on", None, "patch_for"),
    ("patch for linux 6.1.2", "linux 6", None, "patch_for"),
    (" \tpatch for  Red Hat on 1/2/2026\ufeff", "red hat", "20260102", "patch_for"),
    ("patch for Debian on 1/2/2026", "debian", "20260102", "patch_for"),
    ("patch for a on b on 1-2-2026", "a", "20260102", "patch_for"),
    ("patch for   ?", None, None, "unknown"),
    ("linux-dist version on 2026-02-02", None, None, "linux_text"),
    ("android and linux", None, None, "os"),
    ("patch version for linux", None, None, "linux_text"),
    ("Android on 03-04-2026", None, "20260304", "os"),
    ("on 3/4/2026", None, "20260304", "os"),
    ("notebook", None, None, "os"),
    ("is the os new", None, None, "os"),
    ("cosmos", None, None, "unknown"),
    ("hhhh", None, None, "unknown"),
    ("", None, None, "unknown"),
    (None, None, None, "unknown"),
]


@pytest.fixture(scope="module")
def parsed(spark, ask, names):
    texts = distinct_texts(ask(*[row[0] for row in PARSES]))
    routed = route(add_vendors(parse(texts), names("Zebra")))
    return {r["text"]: r for r in routed.collect()}


@pytest.mark.parametrize("text,vendor,date,branch", PARSES)
def test_parse_and_branch(parsed, text, vendor, date, branch):
    row = parsed[(text or "").strip(" \t\u00a0\ufeff")]
    assert (row["parsed_vendor"], row["parsed_date"], row["branch"]) == (vendor, date, branch)


def test_first_field_that_is_not_null_wins(spark):
    rows = spark.createDataFrame(
        [("", "patch for Linux", None), (None, " p ", "q"), (None, None, "q"), (None, None, None)],
        "question string, prompt string, q string",
    )
    assert [r[0] for r in rows.select(question_text(rows)).collect()] == ["", "p", "q", ""]


def test_day_first(spark, ask):
    texts = parse(distinct_texts(ask("linux on 14/2/2026")), day_first=True)
    assert texts.first()["parsed_date"] == "20260214"


def test_strict_and_boundary(spark, ask, names):
    texts = parse(distinct_texts(ask("oooo", "cargo train", "use go now")))
    loose = {r["text"]: r for r in route(add_vendors(texts, names("go", "oo"))).collect()}
    assert loose["oooo"]["branch"] == "os" and loose["cargo train"]["vendor_name"] == "go"
    tight = route(add_vendors(texts, names("go", "oo"), boundary=True), strict=True)
    tight = {r["text"]: (r["branch"], r["vendor_name"]) for r in tight.collect()}
    assert tight == {
        "oooo": ("unknown", None),
        "cargo train": ("unknown", None),
        "use go now": ("os", "go"),
    }


def test_longest_name_then_first_and_original_spelling(spark, ask, names):
    texts = distinct_texts(ask("a windows box", "macos or linux", "R rules", "none"))
    listed = names(" Win", "Windows ", "WINDOWS", "MacOS", "Linux", "R", None, " ")
    found = {r["text_key"]: r["vendor_name"] for r in resolve_vendor(texts, listed).collect()}
    assert found == {"a windows box": "Windows", "macos or linux": "MacOS"}


def test_names_contain_vendors_and_are_contained(spark, names):
    asked = spark.createDataFrame(
        [(v,) for v in ("nation_25", "ation", "linux kernel", "x", "", None, " Linux ")], "v string"
    )
    listed = names("NATION_2", "Linux", "q", None, "")
    found = {r["v"] for r in vendors_in_names(asked, "v", listed).collect()}
    assert found == {"nation_25", "ation", "linux kernel", "x", "linux"}


def test_copies_are_folded_and_long_texts_keep_a_short_key(ask):
    long = "linux " * 4000
    texts = distinct_texts(ask(long, long + " ", "short", "short"))
    rows = texts.select("text_key", F.length("text").alias("n")).collect()
    assert sorted((len(r["text_key"]), r["n"]) for r in rows) == [(5, 5), (129, 23999)]


def test_a_text_never_has_the_key_of_a_digest(ask):
    long = "android version " * 20
    asked = ask(long, hashlib.sha512(long.strip().encode()).hexdigest())
    digest = "#" + hashlib.sha512(long.strip().encode()).hexdigest()
    for texts in (distinct_texts(asked), folded_texts(asked), folded_texts(ask(long, digest))):
        assert texts.select("text_key").distinct().count() == 2
        assert texts.count() == 2
