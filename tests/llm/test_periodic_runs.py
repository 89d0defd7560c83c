"""Periodic runs against all periods and places."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from plumbline.llm import periodic_runs as P
from plumbline.llm.queries import all_queries

SF = "/root/testdata/sf0.001"


def plain(words, least=24, times=3):
    found = {}
    for period in range(1, len(words) // times + 1):
        start = 0
        while start + period < len(words):
            end = start
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end > start and end + period - start >= max(least, times * period):
                found.setdefault((start, end + period), period)
            start = max(end, start + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_collapsed(words, runs):
    dropped = {i for s, length, period in runs for i in range(s + period, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def random_words(rng):
    kinds = rng.choice([1, 2, 2, 3, 5, 50])
    word = lambda: str(rng.randrange(kinds)).encode()
    words = [word() for _ in range(rng.randint(0, 160))]
    for _ in range(rng.randint(0, 4)):
        period = [word() for _ in range(rng.randint(1, 25))]
        if rng.random() < 0.4:  # periods that are nearly periodic themselves
            period = (period[: rng.randint(1, 4)] * 20)[: len(period) - 1] + [b"z"]
        at = rng.randint(0, len(words))
        words[at:at] = (period * 8)[: rng.randint(1, len(period) * 6)]
    return words * rng.choice([1, 1, 1, 2, 3, 4])


@pytest.mark.parametrize("least,times", [(24, 3), (24, 4), (9, 3), (3, 3)])
def test_equals_all_periods(least, times):
    rng = random.Random(least * 10 + times)
    texts = [random_words(rng) for _ in range(300)]
    for words, runs in zip(texts, P.find_runs(texts, least, times)):
        assert [tuple(r) for r in runs.tolist()] == plain(words, least, times)


def test_batches_change_nothing(monkeypatch):
    rng = random.Random(8)
    texts = [random_words(rng) for _ in range(60)]
    whole = [r.tolist() for r in P.find_runs(texts)]
    monkeypatch.setattr(P, "WORDS", 50)
    assert [r.tolist() for r in P.find_runs(texts)] == whole


def test_successor_equals_a_search():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.permutation(97)
    tree = P.Successor(values)
    for _ in range(300):
        begin, end = sorted(rng.integers(0, 98, 2))
        bound = int(rng.integers(0, 97))
        below = int(tree.below(np.array([begin]), np.array([end]), np.array([bound]))[0])
        assert below == (values[begin:end] < bound).sum()
        if below < end - begin:
            found = tree.nth(np.array([begin]), np.array([end]), np.array([below]))[0]
            assert found == min(v for v in values[begin:end] if v >= bound)


def test_too_few_periods_are_refused():
    with pytest.raises(ValueError):
        P.find_runs([], 24, 2)


def test_nulls_long_texts_ties_and_clashing_columns(docs):
    rows = [(1, None), (2, ""), (None, "a b " * 20), (4, "a b " * 20), (4, "a b " * 20), (5, "x y \t\n" * 30_000), (6, "lone")]
    found = P.periodic_runs(docs(*rows).withColumnRenamed("size", "runs")).collect()
    assert len(found) == len(rows)
    for row in found:
        text = next(t for i, t in rows if i == row["doc_id"])
        words = (text or "").encode().split()
        runs = [tuple(r) for r in row["runs"]]
        if len(words) < 1000:
            assert runs == plain(words)
        assert row["n_words"] == len(words)
        assert row["collapsed"] == plain_collapsed([w.decode() for w in words], runs)
    assert [tuple(r) for r in next(r for r in found if r["doc_id"] == 5)["runs"]] == [(0, 30_000, 1)]


def test_empty(docs):
    assert P.periodic_runs(docs((1, "x")).where("doc_id = 2")).collect() == []


def test_query(spark):
    found = {r["doc_id"]: r for r in all_queries()["op13_periodic_runs"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert found.keys() == texts.keys()
    some = 0
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        elif n > 2000:
            continue  # too many periods for the plain way
        runs = plain(words)
        row = found[doc_id]
        lines = "".join(f"{s},{length},{period}\n" for s, length, period in runs)
        assert row["n_runs"] == len(runs)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        some += bool(runs)
    assert some > 10
