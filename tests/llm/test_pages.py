"""WARC archives and URL filters."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from plumbline.llm import url_filter, warc
from plumbline.llm.queries import RULES, SQL, all_queries, prepare
from workload.check import connect

SF = "/root/testdata/sf0.001"
BIG = "<html>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\n</html>"


@pytest.fixture(scope="module")
def pages(spark):
    prepare(spark)

    def make(*rows):
        filled = [(*r, "x", 1) for r in rows]
        return spark.createDataFrame(filled, "page_id long, url string, html string, digest string, offset long").repartition(3)

    return make


ROWS = [
    (5, "http://a.org/", BIG), (3, "http://b.org/\r\nX: 1", BIG), (9, None, BIG), (4, "", None), (7, "u", ""),
    (8, "u", "short"), (10, "u", "short"), (11, "u", "y" * 99), (12, "u", "y" * 99), (13, "u", "y" * 100),
    (14, "u", "y" * 100), (None, "u", "y" * 100), (None, "u", None), (20, "u", "\x00" * 3_000_000), (21, "v", "\x00" * 3_000_000),
    (3, "http://again", BIG),
]


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    for page, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and page != first[html]
        yield (page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html] if again else None)


def test_archives_hold_what_was_written(pages, spark):
    index = warc.write_archives(pages(*ROWS))
    got = warc.read_records(index).select("page_id", "payload_bytes", "digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected(ROWS), key=repr)
    records = warc.read_records(index).collect()
    for r in records:
        assert r["payload"] is None if r["record_type"] == "revisit" else hashlib.sha256(r["payload"]).hexdigest() == r["digest"]
    some = index.where("page_id in (3, 14, 20)")
    assert sorted(r["page_id"] for r in warc.read_records(some, gap=0, read=10).collect()) == [3, 3, 14, 20]
    assert "http://b.org/%0D%0AX: 1" in {r["url"] for r in records}


def test_damage_is_noticed(pages):
    member = warc.write_record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None, False, "d")
    with pytest.raises(ValueError, match="digest"):
        warc.read_record(member)


def test_no_pages_no_records(pages):
    index = warc.write_archives(pages(ROWS[0]).where(F.lit(False)))
    assert index.count() == 0 and warc.read_records(index).count() == 0


@pytest.mark.parametrize("name", ["op4_warc"])
def test_query_equals_sql(spark, name):
    df = all_queries()[name](spark, SF)
    cursor = connect(SF).execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


URLS = [
    ("https://WWW.Example.org/es/1?x#y", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("ftp://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
    ("ftp://a.com/de/x://b.org/", "a.com", "/de/x://b.org/", "com/de/", "block"),
    ("x://org", "org", "", None, None),
    ("x://org?q=/", "org", "", None, None),
    ("x://a.net/fr/", "a.net", "/fr/", None, None),
    ("a.org/es/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("://É.ORG/\nz", "É.org", "/\nz", "org/", "allow"),
    ("http://" + "a" * 20_000 + ".org/" + "b" * 20_000, "a" * 20_000 + ".org", "/" + "b" * 20_000, "org/", "allow"),
]


def test_rules(pages):
    rows = pages(*[(i, u[0], None) for i, u in enumerate(URLS)])
    got = {r["page_id"]: r for r in url_filter.judge_urls(rows, RULES).collect()}
    for at, (_, host, path, rule, verdict) in enumerate(URLS):
        row = got[at]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block")


def test_one_class_or_none_in_training(pages, spark):
    rows = pages((1, "http://a.net/", None), (2, "http://a.org/", None))
    assert {r["verdict"] for r in url_filter.judge_urls(rows, [("allow", "org", "/")]).collect()} == {"allow"}
    assert {r["verdict"] for r in url_filter.judge_urls(rows, [("block", "org", "/")]).collect()} == {"allow", "block"} - {"allow"}
    assert {r["verdict"] for r in url_filter.judge_urls(rows, []).collect()} == {"allow"}
    assert url_filter.judge_urls(rows.where(F.lit(False)), RULES).count() == 0


def test_trees_learn_what_labels_say(pages, spark):
    """Held-out URLs: many parameters and digits are blocked, however the host is called."""
    def make(n, host):
        return [
            (i, f"http://{host}{i % 9}.net/p{'?' + '&'.join(f'k{j}={i}{j}' for j in range(6)) if i % 2 else ''}", None)
            for i in range(n)
        ]

    known = pages(*make(400, "a")).withColumn("verdict", F.when(F.col("page_id") % 2 == 1, "block").otherwise("allow"))
    got = url_filter.judge_urls(pages(*make(100, "new")), [], known.select("url", "verdict"))
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in got.collect())


def test_suffixes_and_domains_are_counted_over_all_rows(pages):
    """However few rows train the trees, and also where no row has a label."""
    rows = [(i, f"http://h{i}.{'ab'[i % 2]}{i // 20}.{('org', 'com', 'net')[i % 3]}/p{i}", None) for i in range(300)]
    table = pages(*rows)
    verdict = F.when(F.col("url").contains(".net/"), None).when(F.col("page_id") % 4 == 0, "block").otherwise("allow")
    model = url_filter.train(table.withColumn("verdict", verdict), most=20, pages=table)
    told, counts = {"suffix": {}, "domain": {}}, {"suffix": model.suffixes, "domain": model.domains}
    for at, url, _ in rows:
        host = url.split("/")[2].split(".")
        for kind, key in (("suffix", host[-1]), ("domain", ".".join(host[-2:]))):
            n, known, blocked = told[kind].get(key, (0, 0, 0))
            labelled = host[-1] != "net"
            told[kind][key] = (n + 1, known + labelled, blocked + (labelled and at % 4 == 0))
    for kind, frame in counts.items():
        got = {r[f"_{kind}"]: (r[f"{kind}_rows"], r[f"{kind}_rate"]) for r in frame.collect()}
        assert set(got) == set(told[kind])
        for key, (n, known, blocked) in told[kind].items():
            assert got[key] == pytest.approx((math.log1p(n), (blocked + 1) / (known + 2)))


def test_a_hot_url_is_one_row_of_the_sample(pages):
    """Drawn whatever its hash, with the weight of its rows; the others as a bounded share."""
    for hot in ("http://hot.org/", "http://warm.org/", None):
        rows = pages(*[(i, hot if i % 3 == 0 else f"http://a{i}.org/", None) for i in range(3000)])
        known = rows.select("url", (F.col("page_id") % 2).cast("double").alias("label"))
        got = {(r["url"], r["label"]): r["weight"] for r in url_filter._drawn(known, 100).collect()}
        assert got[hot, 0.0] == got[hot, 1.0] == 500 and 30 < len(got) < 120
        assert {w for (u, _), w in got.items() if u != hot} == {30.0}
    assert {r["weight"] for r in url_filter._drawn(known, 5000).collect()} == {500.0, 1.0}


def test_native_plan(spark):
    text = all_queries()["op6_url_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"):
        assert word not in text
