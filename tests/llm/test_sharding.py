"""Shards of nearly equal bytes."""

import math
import zlib

from plumbline.llm.queries import all_queries
from plumbline.llm.sharding import ROW_BYTES, read_shards, shard_documents, write_shards

SF = "/root/testdata/sf0.001"


def rows_of(found):
    return [(r["doc"]["doc_id"], r["doc"]["text"], r["shard"], r["slot"]) for r in found.collect()]


def size(text):
    return len((text or "").encode()) + ROW_BYTES


def by_shard(rows, shards):
    slots, sizes = [[] for _ in range(shards)], [0] * shards
    for _, text, shard, slot in rows:
        slots[shard].append(slot)
        sizes[shard] += size(text)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sizes


def test_every_row_once_in_even_shards(docs):
    table = docs(*[(i, "w" * (i * 37 % 400)) for i in range(3000)], partitions=7)
    rows = rows_of(shard_documents(table, 8, range_bytes=4096))
    assert sorted(r[:2] for r in rows) == sorted((i, "w" * (i * 37 % 400)) for i in range(3000))
    sizes = by_shard(rows, 8)
    assert max(sizes) - min(sizes) <= 0.06 * max(sizes) + 2 * size("w" * 400)


def test_equal_rows_of_a_crowd_are_split(docs):
    table = docs(*[(None, "the same text")] * 2000, *[(i, f"other {i}") for i in range(500)], partitions=5)
    sizes = by_shard(rows_of(shard_documents(table, 10, range_bytes=1024)), 10)
    assert max(sizes) < 1.3 * sum(sizes) / 10


def test_small_groups_of_equal_texts_stay_together(docs):
    table = docs(*[(i, f"text number {i // 3}") for i in range(6000)])
    shards = {}
    for _, text, shard, _ in rows_of(shard_documents(table, 6)):
        shards.setdefault(text, set()).add(shard)
    assert all(len(found) == 1 for found in shards.values())


def test_nulls_long_texts_and_few_rows(docs):
    rows = [(1, None), (2, ""), (2, ""), (None, None), (5, "é" * 200_000), (6, "x")]
    found = rows_of(shard_documents(docs(*rows), 24))
    assert sorted(map(repr, (r[:2] for r in found))) == sorted(map(repr, rows))
    by_shard(found, 24)


def test_empty(docs):
    assert rows_of(shard_documents(docs((1, "x")).where("doc_id = 2"), 4)) == []


def test_columns_with_clashing_names_are_kept(docs):
    table = docs((1, "a"), (2, "b")).withColumnsRenamed({"lang": "shard", "source": "range", "n_chars": "place"})
    found = shard_documents(table, 2).collect()
    assert found[0]["doc"].asDict().keys() == set(table.columns)


def test_slots_are_those_of_the_files(spark, docs):
    table = docs(*[(i, f"text {i}") for i in range(200)])
    folder = write_shards(table, 4)
    assert sorted(rows_of(read_shards(spark, folder, table))) == sorted(rows_of(read_shards(spark, folder, table)))


def test_query(spark):
    found = all_queries()["op11_sharding"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    sizes, slots = [0] * 24, [[] for _ in range(24)]
    for r in found:
        assert (r["size"], r["text_crc32"]) == (size(texts[r["doc_id"]]), zlib.crc32(texts[r["doc_id"]].encode()))
        assert r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    largest = max(map(size, texts.values()))
    assert max(abs(s - math.fsum(sizes) / 24) for s in sizes) <= largest + 0.03 * max(sizes)
