"""Fingerprints, token counts, exact copies and the byte-level codec, on awkward texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import byte_bpe, exact_dedup, fingerprints, token_counts
from plumbline.llm.queries import COUNTED, ENCODED, all_queries

SF = "/root/testdata/sf0.001"
LONG = "word " * 60_000
AWKWARD = [
    None, "", " ", "\n\n", "a", "A", "Straße É é ǅ", "x" * 5000, LONG, LONG.upper(), "=" * 301, "a  b\t\tc \n",
    "<|endoftext|>", "one<|endoftext|>two <|endoftext|>", "I'll we've 'S", "漢字かな한국어", "🙂👩‍👩‍👧", "\x00\x1f\x85\u2028",
    "\u0378\U0003fc3d x", "ab" * 700, "aaaaab" * 90,
]


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(ENCODED))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, Tokenizer.from_file(public_tokenizers.path(COUNTED))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# -- tokens --------------------------------------------------------------------------------


def test_token_counts_equal_the_library(docs, library):
    got = by_id(token_counts.token_counts(docs(*AWKWARD), public_tokenizers.path(COUNTED)))
    for at, text in enumerate(AWKWARD):
        want = len(library[1].encode(text or "", add_special_tokens=False).ids)
        assert (got[at]["n_tokens"], got[at]["n_bytes"]) == (want, len((text or "").encode()))
        assert got[at]["over_limit"] == (want > 512)


def test_token_count_query_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = by_id(all_queries()["op2_token_counts"](spark, SF))
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        assert got[doc]["n_tokens"] == len(library[1].encode(text, add_special_tokens=False).ids)


_counter = _codec = None


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab =\n'\u00a0é"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_any_text_is_counted_and_coded_as_the_libraries_do(library, text):
    counter = token_counts.counter(public_tokenizers.path(COUNTED))
    assert counter.count(text) == len(library[1].encode(text, add_special_tokens=False).ids)
    codec = byte_bpe.codec(public_tokenizers.path(ENCODED))
    packed = codec.encode([text])[0]
    assert np.frombuffer(packed, dtype="<u4").tolist() == library[0].encode_ordinary(text)
    assert codec.decode(packed) == text


def test_codes_equal_the_library_and_offsets_hold(docs, library):
    path = public_tokenizers.path(ENCODED)
    rows = by_id(byte_bpe.encode(docs(*AWKWARD), path))
    back = by_id(byte_bpe.decode(byte_bpe.encode(docs(*AWKWARD), path), path))
    for at, text in enumerate(AWKWARD):
        text, row = text or "", rows[at]
        assert row["ids"] == library[0].encode_ordinary(text)
        assert back[at]["text"] == text and bytes(back[at]["bytes"]) == text.encode()
        for token, start, end in list(zip(row["ids"], row["starts"], row["ends"]))[:500]:
            assert library[0].decode_single_token_bytes(token) in text[start:end].encode()


def test_the_round_trip_has_the_offsets_too(docs):
    path = public_tokenizers.path(ENCODED)
    texts = ["", None, "plain words here", "é 漢字 \U0001f600\U0001f9ff x", "a\x00b\r\n  "]
    rows = docs(*enumerate(texts))
    want = {r["doc_id"]: (r["ids"], r["starts"], r["ends"]) for r in byte_bpe.encode(rows, path).collect()}
    for r in byte_bpe.round_trip(rows, path).collect():
        got = tuple(np.frombuffer(r[c], dtype="<i4").tolist() for c in ("ids", "starts", "ends"))
        assert got == want[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_cut_characters_are_replaced_in_texts_only(spark):
    path = public_tokenizers.path(ENCODED)
    codec = byte_bpe.codec(path)
    first = [i for i in np.frombuffer(codec.encode(["🙂"])[0], dtype="<u4").tolist()][:1]
    rows = spark.createDataFrame([(1, first), (2, None), (3, [])], "doc_id long, ids array<int>")
    back = by_id(byte_bpe.decode(rows, path))
    assert back[1]["text"].startswith("\ufffd") and bytes(back[1]["bytes"]) == codec.bytes_of[first[0]]
    assert back[2]["text"] == back[3]["text"] == ""


def test_codec_query_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = by_id(all_queries()["op5_byte_bpe"](spark, SF))
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        ids = library[0].encode_ordinary(text)
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# -- exact copies --------------------------------------------------------------------------


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("capacity", [1024, 4])
def test_exact_groups(docs, capacity):
    texts = [*AWKWARD, *["Copy É"] * 40, *["cOPY É"] * 7, "copy é", *map(str, range(60)), "7"]
    rows = [(at * 3, t) for at, t in enumerate(texts)] + [(6, None), (None, "alone"), (None, "copy é")]
    groups = {}
    for doc, text in rows:
        groups.setdefault(lowered(text), []).append(doc)
    got = exact_dedup.exact_groups(docs(*rows), capacity=capacity).collect()
    assert len(got) == len(rows)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), i == keep, digest) for i in ids]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_frequent_digests_are_verified(docs):
    rows = docs(*["hot"] * 300, *map(str, range(200)))
    digests = exact_dedup.text_digests(rows)
    found = exact_dedup.frequent_digests(digests, capacity=8).collect()
    assert [(r["keep_id"], r["group_size"]) for r in found] == [(299, 300)]
    assert exact_dedup.drop_copies(rows).count() == 201


# -- fingerprints --------------------------------------------------------------------------


def test_fingerprints_of_neighbours(docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = [*AWKWARD, *[" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(60)]]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    got = by_id(fingerprints.with_next(docs(*rows)))
    ordered = sorted((i, t or "") for i, t in rows)
    assert got.keys() == set(ids)
    for (doc, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        size = len(text) // 4
        edited = text[: len(text) - size] + after[:size]
        row, marks = got[doc], [fingerprints.fingerprint(t) for t in (text, edited, after)]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert [row["fingerprint"], row["edited_fingerprint"]] == [f"{m:016x}" for m in marks[:2]]
        assert row["near_edited"] == 1 - (marks[0] ^ marks[1]).bit_count() / 64
        assert row["near_next"] == 1 - (marks[0] ^ marks[2]).bit_count() / 64
    long = [got[i] for i, t in rows if t and 200 < len(t) < 1000 and " w" in t]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.9 * len(long)


def test_a_single_document_follows_itself(docs):
    row = fingerprints.with_next(docs("one two three four")).first()
    assert row["near_next"] == 1.0


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    marks = set()
    for mark in base:
        for _ in range(25):
            marks.add(mark ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    index = spark.createDataFrame([(f"{m:016x}",) for m in marks] + [(None,)], "fingerprint string")
    asked = [f"{m:016x}" for m in sorted(marks)[::7]]
    queries = spark.createDataFrame([(a,) for a in asked], "fingerprint string")
    for radius, blocks in ((3, 4), (3, 5), (3, 6), (1, 2), (0, 1)):
        got = {tuple(r) for r in fingerprints.within_radius(index, queries, radius, blocks).collect()}
        want = {
            (a, f"{m:016x}", d) for a in asked for m in marks if (d := (int(a, 16) ^ m).bit_count()) <= radius
        }
        assert got == want
    with pytest.raises(ValueError):
        fingerprints.block_masks(3, 3)


# -- all of them ---------------------------------------------------------------------------


def test_empty_tables_give_empty_results(docs):
    none = docs("x").where(F.lit(False))
    path = public_tokenizers.path
    assert token_counts.token_counts(none, path(COUNTED)).count() == 0
    assert byte_bpe.round_trip(none, path(ENCODED)).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0
    assert fingerprints.with_next(none).count() == 0
    assert fingerprints.fingerprints(none).count() == 0


def test_repeated_rows_are_counted_each(docs):
    rows = docs((1, "same text here"), (1, "same text here"), (1, "other"))
    assert token_counts.token_counts(rows, public_tokenizers.path(COUNTED)).count() == 3
    assert fingerprints.with_next(rows).count() == 3
