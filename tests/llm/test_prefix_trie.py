"""The prefix trie against a plain one, with segments and shards so small that all ways are taken."""

import hashlib
import random

import numpy as np
import pytest

from plumbline.llm.prefix_trie import _digests, in_order, pack, prefix_trie
from plumbline.llm.queries import SQL, all_queries, prepare
from workload.check import connect

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def talk(spark):
    prepare(spark)

    def make(rows):
        filled = [(*row, "x", 1) for row in rows]
        kind = "conv_id long, turn long, role string, text string, pos string, n long"
        return spark.createDataFrame(filled, kind).repartition(3)

    return make


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    nodes = {}
    for conv, turns in convs.items():
        path = tuple(t[2:] for t in sorted(turns))
        for depth in range(len(path) + 1):
            node = nodes.setdefault(path[:depth], {"members": [], "ends": []})
            node["members"].append(conv)
        node["ends"].append(conv)
    out = []
    for path, node in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        out.append((
            min(node["members"]), len(path), min(nodes[path[:-1]]["members"]) if path else None, len(node["members"]),
            len(children), sum(not any(q[:-1] == p and q for q in nodes) for p in below),
            sum((len(nodes[p]["members"]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(turns, **sizes):
    numbered = in_order(turns)
    nodes = prefix_trie(numbered, numbered.select("conv_id").distinct(), **sizes)
    return sorted((tuple(row) for row in nodes.select(*COLUMNS).collect()), key=repr)


def random_talk(seed, convs=40):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.choice([1, 2, 3, 3, 4, 9])):
            rows.append((conv * 7 - 30, turn, rng.choice(["user", "bot"]), rng.choice(["a", "bb", "é😀", ""])))
    same = [(1000 + i, turn, "user", text) for i in range(12) for turn, text in enumerate("abcab")]
    long = [(2000 + i, turn, "user", "abc"[turn % 3] if turn < 40 else str(i)) for i in range(3) for turn in range(45)]
    return rows + same + long


def test_equals_a_plain_trie(talk):
    rows = random_talk(1)
    assert found(talk(rows)) == plain(rows)


def test_small_segments_and_shards_change_nothing(talk):
    rows = random_talk(2)
    assert found(talk(rows), segment=4, shard=8, chunk=10) == plain(rows)


def test_nulls_ties_and_repeats(talk):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "bot", "x"), (1, 1, "a", "y"),
        (2, None, "", ""), (2, 0, "user", "x"), (None, 0, "user", "lost"), (3, 5, "us", "erx"), (4, 5, "user", "x"),
        (5, 0, "user", "w" * 100_000),
    ]
    assert found(talk(rows)) == plain(rows)


def test_a_crowd_of_equal_turns_keeps_its_places(talk):
    rows = [(7, 1, "user", "same")] * 300 + [(7, 2, "user", "end"), (8, 1, "user", "same")]
    assert found(talk(rows), segment=32, shard=40) == plain(rows)


def test_empty(talk):
    assert found(talk([])) == []


def test_turns_are_numbered_across_tasks(talk):
    rows = [(1, turn, "user", str(turn)) for turn in range(500)] + [(c, 0, "user", "x") for c in range(2, 30)]
    placed = in_order(talk(rows).repartition(7)).where("conv_id = 1")
    assert sorted(row["pos"] for row in placed.collect()) == list(range(1, 501))


def test_the_arrays_hold_just_the_sequences():
    rng = np.random.default_rng(3)
    words = {tuple(rng.integers(0, 50, rng.integers(1, 6)).tolist()) for _ in range(400)}
    lengths = np.array([len(w) for w in words])
    trie = pack(np.array([n for w in words for n in w]), lengths)
    for word in words:
        state = np.zeros(1, dtype=np.int64)
        for label in word:
            state = trie.step(state, np.array([label]))
    prefixes = {w[:d] for w in words for d in range(1, len(w) + 1)}
    assert (trie.check[: trie.end] >= 0).sum() == len(prefixes) + 1
    with pytest.raises(ValueError):
        trie.step(np.zeros(1, dtype=np.int64), np.array([50]))


def test_lists_of_ids_are_hashed_in_pieces(spark, talk):
    ends = spark.createDataFrame([(i % 2, 5, i * 3 - 100) for i in range(400)], "depth long, k1 long, conv_id long")
    got = {row["depth"]: row["ends_sha256"] for row in _digests(ends.repartition(5), ["depth", "k1"], piece=20).collect()}
    for side in (0, 1):
        ids = ",".join(str(i * 3 - 100) for i in range(400) if i % 2 == side)
        assert got[side] == hashlib.sha256(ids.encode()).hexdigest()


def test_query_equals_its_sql(spark):
    cursor = connect(SF).execute(SQL["op12_prefix_trie"])
    names = [d[0] for d in cursor.description]
    ours = [tuple(row[n] for n in names) for row in all_queries()["op12_prefix_trie"](spark, SF).collect()]
    assert sorted(ours, key=repr) == sorted(cursor.fetchall(), key=repr)
