"""Lookups against a plain reading of their rules on random dirty releases."""

import random
import re

import pytest

from plumbline.operators import staging
from plumbline.operators.lookups import (
    attach_releases,
    dated_patch,
    latest_per_product,
    product_release,
    vendor_patch,
)


def digits(text):
    return re.sub("[^0-9]", "", text or "")[:8]


def lowered(tags):
    return [t.lower() for t in tags or []]


def newest(docs):
    return min(docs, key=lambda d: (-(d.get("ts_ms") or 0), d["pos"]))["pos"] if docs else None


def earliest(docs):
    return min((d["pos"] for d in docs), default=None)


def expect_product(docs, key, date, fallback):
    mine = [d for d in docs if key in [(d.get("name") or "").lower(), *lowered(d.get("tags"))]]
    if not mine:
        return earliest(docs) if fallback == "first" else None
    same = [d for d in mine if date and digits(d.get("release_date")) == date]
    usable = [d for d in mine if date and len(digits(d.get("release_date"))) >= 6]
    if same or not usable:
        return newest(same or mine)
    gaps = {d["pos"]: abs(int(digits(d["release_date"])) - int(date)) for d in usable}
    return newest([d for d in usable if gaps[d["pos"]] == min(gaps.values())])


def expect_vendor(docs, key, date, match):
    def fits(d):
        tags = lowered(d.get("tags"))
        if "patch" not in tags:
            return False
        if match == "any_field":
            named = [(d.get("name") or "").lower(), (d.get("brand") or "").lower()]
            return any(key in field for field in tags + named)
        return key in tags[0] or tags[0] in key

    mine = [d for d in docs if fits(d)]
    tagged = [d for d in mine if date and match == "first_tag" and date in d["tags"]]
    dated = [d for d in mine if date and digits(d.get("release_date")) == date]
    return earliest(tagged or dated) if tagged or dated else newest(mine)


def expect_dated(docs, date):
    if not date:
        return newest(docs)
    asked, found = digits(date), []
    for d in docs:
        text = (d.get("release_date") or "").replace("-", "")
        if asked and (text.startswith(asked) or asked.startswith(text[:8])):
            found.append(d)
    return earliest(found or docs)


DATES = ["20260101", "20260131", "20260201", "20251231", "19991301", "20261402", "00010101"]


def dirty(seed, n=120):
    pick = random.Random(seed)
    vendors = ["linux", "linux kernel", "Android", "an", "red hat", "X", ""]
    shapes = DATES + ["", None, "2026", "2025[29]0213", "2026-01-31", "202601", "2026013", "010101"]
    docs = []
    for pos in pick.sample(range(10 * n), n):
        vendor = pick.choice(vendors)
        tags = [vendor, pick.choice(["patch", "Patch", "beta"]), pick.choice(DATES), "1.2"]
        docs.append(
            {
                "pos": pos,
                "name": pick.choice([vendor, vendor.title(), None]),
                "brand": pick.choice(["Linux Foundation", "Alphabet", None]),
                "release_date": pick.choice(shapes),
                "ts_ms": pick.choice([None, 0, 5, 9, 1700000000000, -4]),
                "tags": pick.choice([tags, tags, tags[1:], [], None]),
            }
        )
    return docs


KEYS = ["linux", "android", "an", "kernel", "patch", "1.2", "red", "linux kernel 6", "zzz", "x"]
PAIRS = [(k, d) for k in KEYS for d in [*DATES, "20300615", ""]]


@pytest.fixture
def requests(spark):
    return spark.createDataFrame(PAIRS, "key string, date string")


def chosen(df):
    return {(r["key"], r["date"]): r["pos"] for r in df.collect()}


@pytest.mark.parametrize("seed,fallback", [(1, "first"), (2, "none"), (3, "first")])
def test_product_release(releases, requests, seed, fallback):
    docs = dirty(seed)
    got = chosen(product_release(requests, releases(*docs), fallback))
    assert got == {(k, d): expect_product(docs, k, d, fallback) for k, d in PAIRS}


@pytest.mark.parametrize("match", ["first_tag", "any_field"])
@pytest.mark.parametrize("seed", [4, 5])
def test_vendor_patch(releases, requests, seed, match):
    docs = dirty(seed)
    got = chosen(vendor_patch(requests, releases(*docs), match))
    assert got == {(k, d): expect_vendor(docs, k, d, match) for k, d in PAIRS}


@pytest.mark.parametrize("seed", [6, 7])
def test_dated_patch(spark, releases, seed):
    docs = dirty(seed)
    if seed == 7:  # without the empty dates that fit every request
        docs = [d for d in docs if d["release_date"]]
    dates = [*DATES, "20300615", "", "2026", "2026-01-31", "soon"]
    requests = spark.createDataFrame([("linux", d) for d in dates], "key string, date string")
    got = chosen(dated_patch(requests, releases(*docs)))
    assert got == {("linux", d): expect_dated(docs, d) for d in dates}


def only(spark, lookup, key, date, docs):
    request = spark.createDataFrame([(key, date)], "key string, date string")
    return lookup(request, docs).first()["pos"]


@pytest.mark.parametrize(
    "dates,asked,expected",
    [
        (["20260131", "20260301"], "20260201", 0),  # 70 against 100
        (["20251231", "20260228"], "20260115", 1),  # by days it would be the first
        (["2026", "20200101"], "20260101", 1),  # too short to be near anything
    ],
)
def test_distance_is_between_numbers(spark, releases, dates, asked, expected):
    docs = releases(*[{"name": "P", "release_date": d} for d in dates])
    assert only(spark, product_release, "p", asked, docs) == expected


def test_equal_distance_goes_to_the_newest_then_the_first(spark, releases):
    docs = releases(
        {"name": "P", "release_date": "20260110", "ts_ms": 5},
        {"name": "P", "release_date": "20260130", "ts_ms": 9},
        {"name": "P", "release_date": "20260130", "ts_ms": 9},
    )
    assert only(spark, product_release, "p", "20260120", docs) == 1


def test_date_in_tags_beats_release_date(spark, releases):
    docs = releases(
        {"tags": ["x", "patch"], "release_date": "20260101"},
        {"tags": ["x", "patch", "20260101"], "release_date": ""},
    )
    assert only(spark, vendor_patch, "x", "20260101", docs) == 1


def test_empty_tables(spark, releases):
    none = releases({"pos": 1}).where("false")
    for lookup in (product_release, vendor_patch, dated_patch):
        assert only(spark, lookup, "x", "20260101", none) is None


def test_latest_and_attach(spark, releases, monkeypatch):
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 0)  # the path for many choices
    docs = releases({"name": "A", "ts_ms": 1}, {"name": "a", "ts_ms": 3}, {"name": "B"})
    rows = attach_releases(latest_per_product(docs), docs).collect()
    assert {(r["key"], r["id"]) for r in rows} == {("a", "d1"), ("b", "d2")}


def test_hot_product_and_sparse_years(spark, releases):
    """Nearest across empty years, with one product holding nearly all releases."""
    pick = random.Random(8)

    def some_day():
        return f"{pick.choice([1999, 2003, 2011, 2026])}{pick.randint(1, 12):02d}{pick.randint(1, 28):02d}"

    docs = [{"pos": i, "name": "hot", "release_date": some_day(), "ts_ms": i % 3} for i in range(400)]
    docs.append({"pos": 1000, "name": "cold", "release_date": "20100101"})
    asked = [("hot", f"{y}{m:02d}15") for y in range(1990, 2031, 3) for m in (1, 6, 12)]
    asked += [("cold", "19000101"), ("cold", "21000101")]
    requests = spark.createDataFrame(asked, "key string, date string")
    got = chosen(product_release(requests, releases(*docs)))
    assert got == {(k, d): expect_product(docs, k, d, "first") for k, d in asked}
