"""The release store against indexes built anew."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import release_store as stores
from plumbline.operators.index import fold_entries
from plumbline.plans.answer import Options, answer_questions, build_index, release_store
from plumbline.streaming.upkeep import release_stream
from workload import views

COLUMNS = ["lookup", "key", "rule", "date", "order", "n"]
TAGS = [None, [], ["linux", "patch", "20260101"], ["a", "patch", "20260101", "20260101"], ["os", "b"], [None, "patch"]]


def random_release(rng, pos):
    return {
        "pos": pos,
        "name": rng.choice(["Linux", "Android", "b", "", None]),
        "channel": rng.choice(["patch", "beta", None]),
        "release_date": rng.choice(["20260101", "2026[29]0105", "", None]),
        "tags": rng.choice(TAGS),
        "ts_ms": rng.choice([None, 1, 2, 3]),
        "notes": f"note {pos}",
    }


def rows_of(index):
    return sorted((tuple(r[c] for c in COLUMNS) for r in index.collect()), key=repr)


@pytest.mark.parametrize("match,steps", [("first_tag", 5), ("any_field", 3)])
def test_index_equals_a_full_build_after_any_changes(spark, releases, tmp_path, match, steps):
    rng = random.Random(match)
    options = Options(match=match)
    store = release_store(spark, str(tmp_path / "store"), options, span=10, buckets=4, segments=2)
    held = {}
    for step in range(steps):
        if step % 3 == 1:  # only further positions
            new, gone = [random_release(rng, 60 + step * 20 + i) for i in range(5)], []
        else:
            new = [random_release(rng, p) for p in rng.sample(range(60), 12)]
            gone = rng.sample(range(60), 6)
        for p in gone:
            held.pop(p, None)
        held |= {r["pos"]: r for r in new}
        store.apply(releases(*new), spark.createDataFrame([(p,) for p in gone], "pos long") if gone else None)
    snapshot = store.snapshot()
    assert sorted(r["pos"] for r in snapshot.releases().collect()) == sorted(held)
    want = rows_of(build_index(releases(*held.values()), options))
    assert rows_of(snapshot.index()) == want
    compacted = store.compact()
    assert compacted.parts["gone"] == {} and all(len(s) == 1 for s in compacted.parts["postings"].values())
    assert rows_of(fold_entries(compacted.postings(), "lookup")) == want


def test_a_change_reads_and_writes_just_the_parts_it_touches(spark, releases, tmp_path):
    store = release_store(spark, str(tmp_path / "store"), span=10, buckets=8)
    store.apply(releases(*[{"pos": p, "name": f"n{p}", "tags": [f"n{p}"]} for p in range(100)]))
    before = store.snapshot()
    after = store.apply(releases({"pos": 205, "name": "n7", "tags": ["n7"]}))
    assert {p: s for p, s in after.parts["evidence"].items() if p != 20} == before.parts["evidence"]
    assert after.parts["evidence"][20] == (2,)
    kept = [p for p in before.parts["index"] if after.parts["index"][p] == before.parts["index"][p]]
    assert len(kept) >= 5
    # what only gains rows is not written again
    assert all(after.parts["postings"][p][: len(s)] == s for p, s in before.parts["postings"].items())


def test_evidence_is_read_by_range(spark, releases, tmp_path, ask, names):
    store = release_store(spark, str(tmp_path / "store"), span=10)
    docs = [{"pos": p, "name": f"vendor{p:03d}", "tags": [f"vendor{p:03d}", "patch", "20260101"], "ts_ms": p} for p in range(100)]
    store.apply(releases(*docs))
    snapshot = store.snapshot()
    chosen = snapshot.releases(spark.createDataFrame([(42,), (47,), (3,), (None,), (5000,)], "pos long"))
    assert {f.rsplit("part=", 1)[1].split("/")[0] for f in chosen.inputFiles()} == {"0", "4"}
    got = answer_questions(ask("patch for vendor042"), snapshot, names("vendor042")).collect()
    assert [r["matched_id"] for r in got] == ["d42"]


def test_a_failed_change_is_not_seen_and_can_be_repeated(spark, releases, tmp_path, monkeypatch):
    store = release_store(spark, str(tmp_path / "store"), span=10, buckets=4)
    store.apply(releases(*[{"pos": p, "name": "a"} for p in range(20)]))
    before = rows_of(store.snapshot().index())
    more = releases(*[{"pos": p, "name": "b"} for p in range(10, 30)])
    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", lambda snapshot: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.apply(more)
    assert rows_of(store.snapshot().index()) == before
    store.apply(more)
    now = releases(*[{"pos": p, "name": "a" if p < 10 else "b"} for p in range(30)])
    assert rows_of(store.snapshot().index()) == rows_of(build_index(now.withColumn("id", F.lit("x"))))


def test_repeated_changes_do_nothing_and_old_versions_are_cleared(spark, releases, tmp_path):
    store = release_store(spark, str(tmp_path / "store"), span=10, buckets=2)
    for delta in (0, 1, 1, 0, 2):
        store.apply(releases({"pos": 1, "name": f"v{delta}"}, {"pos": None, "name": "lost"}), delta=delta)
    assert store.snapshot().version == 3
    reading = store.snapshot(2).releases()
    store.vacuum(keep=2)
    assert [r["name"] for r in reading.collect()] == ["v1"]
    store.vacuum(keep=1)
    assert [r["name"] for r in store.snapshot().releases().collect()] == ["v2"]
    assert store._numbers(f"{store.path}/evidence/segment=1", "part") == []


def test_last_of_a_position_counts_and_columns_are_fitted(spark, releases, tmp_path):
    store = release_store(spark, str(tmp_path / "store"))
    store.apply(releases({"pos": 1, "name": "old"}, {"pos": 1, "name": "new"}).withColumn("seq", F.col("name") == "new"), sequence="seq")
    assert [r["name"] for r in store.snapshot().releases().collect()] == ["new"]
    store.apply(spark.createDataFrame([(2, "x", 5)], "pos int, name string, odd int"))
    assert {(r["pos"], r["name"], r["notes"]) for r in store.snapshot().releases().collect()} == {(1, "new", None), (2, "x", None)}
    store.apply(removed=spark.createDataFrame([(1,), (2,), (3,), (None,)], "pos long"))
    assert store.snapshot().releases().count() == 0 and store.snapshot().index().count() == 0


def test_an_empty_store_and_a_limit_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        release_store(spark, str(tmp_path), Options(evidence_limit=25))
    with pytest.raises(ValueError):
        release_store(spark, str(tmp_path / "none")).apply(removed=spark.createDataFrame([(1,)], "pos long"))


def test_a_stream_of_changes(spark, tmp_path):
    docs = views.releases(spark, "/root/testdata/sf0.001")
    inbox = str(tmp_path / "inbox")
    said = docs.withColumns({"removed": F.lit(False), "seq": F.lit(1)})
    late = said.where("pos % 7 = 0").withColumns({"removed": F.lit(True), "seq": F.lit(2)})
    said.unionByName(late).repartition(2).write.parquet(inbox)
    store = release_store(spark, str(tmp_path / "store"), span=500, buckets=4)
    for _ in range(2):  # again without news
        stream = spark.readStream.schema(said.schema).parquet(inbox)
        release_stream(stream, store, str(tmp_path / "checkpoint"), "seq", {"availableNow": True}).awaitTermination()
    assert store.snapshot().version == 1
    assert rows_of(store.snapshot().index()) == rows_of(build_index(docs.where("pos % 7 <> 0")))


def test_a_change_sorts_no_texts_where_positions_come_once(spark, releases, tmp_path, monkeypatch):
    plans, stage = {}, stores.stage

    def staged(df, label, *more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label, *more)

    monkeypatch.setattr(stores, "stage", staged)
    store = release_store(spark, str(tmp_path / "store"), span=10, buckets=4)
    store.apply(releases(*[{"pos": p, "name": "a", "tags": ["a", "patch"]} for p in range(30)]))
    assert "Aggregate" not in plans["added"] and "added-once" not in plans
    assert "named_struct" not in plans["plus"]  # entries are not built by functions of list elements
    twice = [{"pos": p, "name": n, "tags": ["b"]} for p in (1, 2, 2, 40) for n in ("b", "b")]
    snapshot = store.apply(releases(*twice))
    kept = sorted((r["pos"], r["name"]) for r in snapshot.releases().collect())
    assert kept == sorted((p, "b" if p in (1, 2, 40) else "a") for p in [*range(30), 40])
    assert rows_of(snapshot.index()) == rows_of(build_index(snapshot.releases()))
