import datetime as dt
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plumbline.plans.answer import answer_questions
from plumbline.streaming.answers import answer_stream
from plumbline.operators.events import last_prompts
from plumbline.operators.percentiles import approximate_percentiles
from plumbline.streaming.prompts import current_prompts, prompts_stream
from plumbline.streaming.rollup import append_stream, daily_rollup, rollup_by_day, write_rollup
from workload import queries, views

SF = "/root/testdata/sf0.001"
ONCE = {"availableNow": True}


def test_answers_in_batches_equal_one_batch(spark, tmp_path):
    """Three micro-batches, a restart with new rows, and no row twice."""
    events = views.table(spark, SF, "events")
    questions = views.questions_from(events).repartition(3)
    inbox = str(tmp_path / "inbox")
    questions.where("question_id < 600").write.parquet(inbox)
    docs, names = views.releases(spark, SF), views.vendor_names(spark, SF)

    def run():
        stream = (
            spark.readStream.schema(questions.schema)
            .option("maxFilesPerTrigger", 1)
            .parquet(inbox)
        )
        answer_stream(
            stream, docs, names, str(tmp_path / "answers"), str(tmp_path / "checkpoint"),
            events_path=str(tmp_path / "events"), trigger=ONCE,
        ).awaitTermination()

    run()
    questions.where("question_id between 600 and 799").write.mode("append").parquet(inbox)
    run()
    columns = ["question_id", "status", "reason", "version", "matched_id"]
    got = spark.read.parquet(str(tmp_path / "answers")).select(*columns)
    want = answer_questions(questions.where("question_id < 800"), docs, names).select(*columns)
    assert got.count() == 800 and got.exceptAll(want).count() == 0
    logged = spark.read.parquet(str(tmp_path / "events"))
    assert logged.count() == 800 and logged.where("latency_ms is null").count() == 0


def test_rollup_emits_closed_days_and_drops_late_rows(spark, tmp_path):
    events = views.answer_events(spark, SF)
    inbox = str(tmp_path / "inbox")
    path, checkpoint = str(tmp_path / "rollup"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.schema(events.schema).parquet(inbox)
        write_rollup(daily_rollup(stream), path, checkpoint, ONCE).awaitTermination()

    events.where("ts < '2024-01-15'").write.parquet(inbox)
    run()
    late = events.where("ts < '2024-01-02'").limit(5)
    events.where("ts >= '2024-01-15'").unionByName(late).write.mode("append").parquet(inbox)
    run()
    got = rollup_by_day(spark.read.parquet(path))
    closed = events.where("ts < '2024-01-30'")
    want = rollup_by_day(daily_rollup(closed)).select(got.columns)
    assert got.count() == 29 and got.exceptAll(want).count() == 0


def test_append(spark, tmp_path):
    events = views.answer_events(spark, SF)
    inbox, path = str(tmp_path / "inbox"), str(tmp_path / "log")
    events.write.parquet(inbox)
    stream = spark.readStream.schema(events.schema).parquet(inbox)
    append_stream(stream, path, str(tmp_path / "checkpoint"), ONCE).awaitTermination()
    assert spark.read.parquet(path).agg(F.countDistinct("day"), F.count("pos")).first() == (30, 1000)


def test_last_prompts_across_batches_and_replay(spark, tmp_path):
    rows = views.questions(spark, SF).where("question_id < 40")
    inbox, path = str(tmp_path / "inbox"), str(tmp_path / "prompts")

    def run(checkpoint):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        prompts_stream(stream, path, str(tmp_path / checkpoint), trigger=ONCE).awaitTermination()
        return [r["question_id"] for r in current_prompts(spark, path).orderBy("question_id").collect()]

    rows.repartition(4).write.parquet(inbox)
    want = sorted(r["question_id"] for r in last_prompts(rows).collect())
    assert run("one") == want
    assert run("two") == want  # every batch written again over the first run's folders


def test_approximate_percentiles_are_near(spark):
    df = spark.range(1, 1001).selectExpr("id % 2 as g", "id as v")
    got = approximate_percentiles(df, "v", {"p50": 50}, ("g",)).collect()
    assert all(abs(r["p50"] - 500) <= 2 for r in got)


def test_refreshed_releases(spark, tmp_path, releases, names):
    """New releases are seen from the batch after they appear."""
    inbox, path = str(tmp_path / "inbox"), str(tmp_path / "answers")
    rows = spark.createDataFrame([(1, "patch for Linux")], "question_id long, question string")
    rows = rows.withColumn("asked_at", F.current_timestamp())
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(inbox)
    corpora = iter(
        releases(*[{"name": "Linux", "tags": ["linux", "patch", str(v)]} for v in range(n)])
        for n in (1, 2)
    )
    answer_stream(
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(inbox),
        lambda: next(corpora),
        names("Linux"),
        path,
        str(tmp_path / "checkpoint"),
        trigger=ONCE,
        refresh_every=1,
    ).awaitTermination()
    seen = spark.read.parquet(path).groupBy("batch").agg(F.max("items_count"))
    assert sorted(tuple(r) for r in seen.collect()) == [(0, 1), (1, 2)]


def test_days_of_the_stream_the_log_and_the_summary_agree(spark, tmp_path):
    """In a zone behind UTC, evening events belong to the local day everywhere."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    times = ["2024-01-15T02:00:00Z", "2024-01-15T20:00:00Z", "2024-01-16T03:00:00Z", "2024-01-20T12:00:00Z"]
    rows = spark.createDataFrame(list(enumerate(times)), "pos long, at string")
    rows = rows.selectExpr(
        "pos", "to_timestamp(at) as ts", "'answer' as status", "'os' as flow", "'v' as vendor",
        "5L as latency_ms", "string(null) as reason", "1 as is_vendor_found",
    )
    try:
        for name, want in (
            ("America/New_York", {"2024-01-14": 1, "2024-01-15": 2, "2024-01-20": 1}),
            ("UTC", {"2024-01-15": 2, "2024-01-16": 1, "2024-01-20": 1}),
        ):
            spark.conf.set("spark.sql.session.timeZone", name)
            inbox, log = str(tmp_path / f"in-{name}"), str(tmp_path / f"log-{name}")
            rows.write.parquet(inbox)
            stream = spark.readStream.schema(rows.schema).parquet(inbox)
            append_stream(stream, log, str(tmp_path / f"check-{name}"), ONCE).awaitTermination()
            live = rollup_by_day(daily_rollup(spark.read.parquet(log)))
            assert {str(r["day"]): r["total"] for r in live.collect()} == want
            days = spark.read.parquet(log).groupBy(F.col("day").cast("string").alias("day")).count()
            assert {r["day"]: r["count"] for r in days.collect()} == want
            path = str(tmp_path / f"rollup-{name}")
            stream = spark.readStream.schema(rows.schema).parquet(inbox)
            write_rollup(daily_rollup(stream), path, str(tmp_path / f"c-{name}"), ONCE).awaitTermination()
            closed = rollup_by_day(spark.read.parquet(path)).collect()
            assert {str(r["day"]): r["total"] for r in closed} == {d: n for d, n in want.items() if d < "2024-01-20"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_deliveries_are_spread_over_files(spark, tmp_path, monkeypatch):
    """As many micro-batches as deliveries, each of more than one file."""
    day = dt.datetime(2024, 1, 5)
    tables = {
        "nation": [{"n_nationkey": n, "n_name": f"NATION_{n}"} for n in range(25)],
        "customer": [{"c_custkey": n, "c_mktsegment": "A", "c_nationkey": n % 25} for n in range(30)],
        "orders": [
            {"o_orderkey": n, "o_custkey": n % 30, "o_orderstatus": "PFO"[n % 3], "o_orderdate": dt.date(1995, 1, 1 + n % 28),
             "o_orderpriority": "1-URGENT"} for n in range(200)
        ],
        "events": [{"event_id": n, "ts": day, "user_id": n % 40} for n in range(300)],
    }
    for name, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), tmp_path / f"{name}.parquet")
    made, new_folder = {}, queries.new_folder
    monkeypatch.setattr(queries, "new_folder", lambda s, label: made.setdefault(label, new_folder(s, label)))

    def inside(label, pattern):
        return len(list(Path(made[label].removeprefix("file:")).glob(pattern)))

    queries.all_queries()["stream_answers_logged"](spark, str(tmp_path))
    assert inside("inbox", "part-*") > 4 and inside("logged-answers", "batch=*") == 4
    queries.all_queries()["stream_answers_kept_up"](spark, str(tmp_path))
    assert inside("release-inbox", "part-*") > 3 and inside("release-checkpoint", "commits/[0-9]*") == 3
