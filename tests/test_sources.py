import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import staging
from plumbline.operators.summary import SummaryFilter, filter_events
from plumbline.sources import event_log, landed


@pytest.fixture
def bodies(spark):
    def make(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "page long, body string")

    return make


def ids(df):
    return [r["id"] for r in df.orderBy("pos").collect()]


def test_component_bodies(bodies):
    docs = bodies(
        '  [{"_id":"a"},{"_id":"b"}]',
        '{"components":[{"_id":"c"}],"data":[{"_id":"no"}]}',
        '{"data":[{"_id":"d"}]}',
        '{"components":null,"data":[{"_id":"e"}]}',
        '{"components":{"x":1},"data":[{"_id":"no"}]}',
        '{"data":"[{}]"}',
        "{}",
        "oops",
        None,
    )
    assert ids(landed.releases_from(docs)) == ["a", "b", "c", "d", "e"]
    assert ids(landed.releases_from(docs, landed.PATCH_FIELDS)) == ["a", "b", "no", "d", "e", "no"]


def test_release_columns(bodies):
    body = """{"data":[{"_id":"1","versionTimestamp":1740363996589,"isCve":true,
      "versionSearchTags":["linux","patch"],"versionVerfied":"yes","versionNumber":7,
      "classification":{"securityType":["SECURITY"],"componentType":["OS"]},"other":1},
      {"_id":"2","version_search_tags":["x"]}]}"""
    rows = landed.releases_from(bodies(body)).orderBy("pos").collect()
    assert rows[0]["ts_ms"] == 1740363996589 and rows[0]["is_cve"] and rows[0]["verified"] == "yes"
    assert rows[0]["classification"]["componentType"] == ["OS"]
    assert rows[0]["version_number"] == "7"
    assert rows[1]["tags"] == ["x"] and rows[1]["name"] is None


AWKWARD = [
    '  [{"_id":"a"},{"_id":"b"}]', '{"components":[{"_id":"c"}],"data":[{"_id":"no"}]}', '{"components":null,"data":[{"_id":"e"}]}',
    '{"total":3}', "[]", " [ ] ", "{}", "", " ", "oops", "3", '"text, with [commas]"', "null", "[1,,2]", "[1,2,]", "[,1]", "[1]x", "[1] [2]",
    '[{"_id":"a"},', '[{"_id":"a"}', '{"data":[{"_id":"a"}]', '{"data":[{"_id":"a"}}', "[}", '{"data":[1},"x":2]', '[[{"_id":"n"}],{"_id":"m"}]',
    r'[{"_id":"q\"u,o[t]e\\"},{"_id":"\\\\\",{"}]', r'{"n\"a,me":[1,2],"data":[{"_id":"z"},null,5,"s",[1]]}',
    '{"data":[{"_id":"1"}],"data":[{"_id":"2"}]}', '{"a":1,"a":2,"data":[{"_id":"1"}]}', '{"data":{"x":[1,2],"y":"a,b"},"components":[{"_id":"y"}]}',
    '{"x":{"y":1,"z":[1,{"w":2}]},"data":[\n{"_id":"t"} ,\t{"_id":"u"}\n] , "end":"a,]}"}', '{"x":{"y":1,},"data":[{"_id":"1"}]}',
    '{"data":[{"_id":"1"}],}', '{"data" : [ ] , "components" : [ {"_id":"w"} ] }', '{"data":[{"_id":"1"}]}}', ',[1]', '[1],', '{"data":[{"a":1,"a":2}]}',
    '{"\\u0064ata":[{"_id":"esc"}]}', '[{"_id":"é😀,"},{"_id":"日本"}]', '{"data":[{"_id":"1"}] "x":1}', '{"data" [1]}', '{data:[1]}', r'[{"_id":"a\"}]',
    '[' + ",".join(f'{{"_id":"{i}","versionReleaseNotes":"{"x, " * (i % 5)}"}}' for i in range(60)) + "]",
]


def test_bodies_read_the_same_at_any_size(spark, bodies, monkeypatch):
    docs = bodies(*AWKWARD, None)
    want = {}
    for fields in (landed.COMPONENT_FIELDS, landed.PATCH_FIELDS):
        want[fields] = landed.releases_from(docs, fields).orderBy("pos").collect()
    assert len(want[landed.PATCH_FIELDS]) > 70
    monkeypatch.setattr(landed, "LARGE", -1)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for (fields, rows), block in zip(want.items(), ("40", "1000")):  # many blocks in a body, or few
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            assert landed.releases_from(docs, fields).orderBy("pos").collect() == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_body_is_read_by_several_tasks(spark, tmp_path):
    items = ",".join(f'"name {i}, of {"[" * (i % 3)}"' for i in range(40_000))
    folder = tmp_path / "landed" / "id=5" / "page=2"
    os.makedirs(folder)
    (folder / "body.json").write_text('{"count":40000,"names":[' + items + "]}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        pieces = landed.read_pieces(spark, str(tmp_path / "landed"))
        assert pieces.select("block").distinct().count() >= 7
        names = landed.unwrap_files(spark, str(tmp_path / "landed"), T.StringType(), landed.NAME_FIELDS)
        got = names.orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["pos"] for r in got] == [2 * landed.PAGE_SPAN + i for i in range(40_000)]
    assert [r["item"] for r in got] == [f"name {i}, of {'[' * (i % 3)}" for i in range(40_000)]


def test_timestamps_are_numbers_or_texts(bodies):
    body = '[{"versionTimestamp":"170"},{"versionTimestamp":1.5},{"versionTimestamp":"x"},{}]'
    rows = landed.releases_from(bodies(body)).orderBy("pos").collect()
    assert [r["ts_ms"] for r in rows] == [170, 1, None, None]


def test_a_run_folder_holds_all_and_can_be_dropped(spark):
    with staging.run_folder(spark) as folder:
        staged = staging.stage(spark.range(3), "numbers")
    path = folder.removeprefix("file:")
    assert staged.count() == 3 and os.listdir(path)
    staging.drop_folder(spark, folder)
    assert not os.path.exists(path)


def test_vendor_names(bodies, spark):
    names = landed.vendor_names_from(bodies('["a"]', '{"names":["b","c"]}', '{"data":["d"]}', "no"))
    assert [r["name"] for r in landed.list_vendors(names).collect()] == ["a", "b", "c", "d"]
    empty = names.where("false")
    assert landed.first_filled(empty, names).count() == 4
    assert landed.first_filled(names, names).count() == 4
    snapshots = spark.createDataFrame(
        [(1, "old", 1), (1, "new", 2), (2, "newer", 2)], "pos long, name string, snapshot_ts long"
    )
    assert [r["name"] for r in landed.latest_snapshot(snapshots).orderBy("pos").collect()] == ["new", "newer"]


def test_event_lines(spark):
    lines = [
        '{"ts":2000,"status":"answer","flow":"os","vendor":"V","latencyMs":3,"reason":null,"isVendorFound":1}',
        "{oops",
        "null",
        "[1]",
        ' {"ts":1000,"status":"","latencyMs":null,"isVendorFound":5}',
        "",
        '{"ts":3000,"status":"error","vendor":"W","latencyMs":"soon","isVendorFound":{"a":1}}',
    ]
    table = spark.createDataFrame(list(enumerate(lines)), "stored_index long, line string")
    rows = event_log.decode_events(table).orderBy("pos").collect()
    fields = ("pos", "status", "flow", "latency_ms", "is_vendor_found")
    assert [tuple(r[f] for f in fields) for r in rows] == [
        (-6, "error", "unknown", None, None),
        (-4, "unknown", "unknown", None, None),
        (0, "answer", "os", 3, 1),
    ]
    assert event_log.decode_events(table, keep_last=1).first()["pos"] == 0


def test_day_partitions_prune(spark, tmp_path):
    import datetime as dt

    rows = spark.range(10).selectExpr(
        "id as pos", "timestamp'2026-03-01 12:00:00' + make_interval(0, 0, 0, id) as ts",
        "'answer' as status", "'os' as flow", "'v' as vendor", "id as latency_ms",
        "'r' as reason", "1 as is_vendor_found",
    )
    path = str(tmp_path / "log")
    event_log.append_events(rows, path)
    kept = filter_events(event_log.read_events(spark, path), SummaryFilter(dt.date(2026, 3, 10), 3))
    assert sorted(r["pos"] for r in kept.collect()) == [7, 8, 9]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_staged_tables_go_to_the_named_folder(tmp_path):
    """The folder is fixed when a session starts, so another process asks for it."""
    code = f"""
from pyspark.sql import SparkSession
from plumbline.operators.staging import stage
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "{tmp_path}/shared/").getOrCreate())
stage(spark.range(3), "numbers")
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=root)
    assert len(list((tmp_path / "shared").glob("numbers-*"))) == 1


def test_the_library_chooses_no_folder_itself():
    class Session:
        class sparkContext:
            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.master": "local[1]"}.get(name, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Session())


def test_staging_overwrites_in_a_work_folder(spark, tmp_path):
    for n in (3, 2):
        staged = staging.stage(spark.range(n), "numbers", str(tmp_path))
        assert staged.agg(F.sum("id")).first()[0] == sum(range(n))
