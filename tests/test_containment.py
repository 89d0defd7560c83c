import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import containment, staging
from plumbline.operators.containment import find_in_texts, find_needles


def brute(texts, needles):
    return {
        (k, n, i + 1)
        for k, t in texts
        for n in needles
        for i in range(len(t) - len(n) + 1)
        if t[i : i + len(n)] == n
    }


def some(seed, alphabet="abé€", longest=7):
    pick = random.Random(seed)

    def word(n):
        return "".join(pick.choice(alphabet) for _ in range(n))

    texts = [(i, word(pick.randint(0, 200))) for i in range(40)] + [(99, word(5000))]
    needles = sorted({word(pick.randint(1, longest)) for _ in range(60)})
    return texts, needles


@pytest.mark.parametrize("seed,rows", [(1, 10**6), (2, 0)])
def test_long_texts_in_pieces(spark, monkeypatch, seed, rows):
    """Occurrences across piece borders count once; so does the join without a broadcast."""
    monkeypatch.setattr(staging, "BROADCAST_ROWS", rows)
    texts, needles = some(seed)
    found = find_in_texts(
        spark.createDataFrame(texts, "k long, t string"),
        "t",
        spark.createDataFrame([(n,) for n in needles], "n string"),
        "n",
    )
    hits = [(r["k"], r["n"], r["start"]) for r in found.collect()]
    assert len(hits) == len(set(hits)) and set(hits) == brute(texts, needles)


def test_needles_longer_than_a_piece(spark):
    needle = "x" * (3 * containment.PIECE) + "y"
    found = find_in_texts(
        spark.createDataFrame([(1, "ab" * 100 + needle + "ab" * 100)], "k long, t string"),
        "t",
        spark.createDataFrame([(needle,), ("ba",)], "n string"),
        "n",
        head=2,
    )
    assert found.where(F.col("n") == needle).first()["start"] == 201
    assert found.where(F.col("n") == "ba").count() == 198


def test_short_texts(spark):
    texts, needles = some(3)
    found = find_needles(
        spark.createDataFrame(texts, "k long, t string"),
        "t",
        spark.createDataFrame([(n,) for n in needles], "n string"),
        "n",
    )
    assert {(r["k"], r["n"], r["start"]) for r in found.collect()} == brute(texts, needles)


@pytest.mark.parametrize("rows", [10**6, 0])
def test_long_needles_are_found_by_their_anchors(spark, monkeypatch, rows):
    """Needles that share most of their stretches, overlap, repeat or lie at the ends."""
    monkeypatch.setattr(staging, "BROADCAST_ROWS", rows)
    pick = random.Random(9)
    word = lambda n: "".join(pick.choice("abé€") for _ in range(n))
    common = word(200)
    needles = [common + word(50), word(50) + common, "ab" * 60, "ab" * 61, common, word(70), word(5), "é", word(1000)]
    texts = [(i, word(30) + needles[i % 9] + word(20) + needles[(i + 4) % 9]) for i in range(18)]
    texts += [(50, needles[0]), (51, needles[0][:-1]), (52, None), (53, ""), (54, "ab" * 200), (55, needles[8][1:])]
    found = find_in_texts(
        spark.createDataFrame(texts, "k long, t string"),
        "t",
        spark.createDataFrame([(n,) for n in needles], "n string"),
        "n",
    )
    hits = [(r["k"], r["n"], r["start"]) for r in found.collect()]
    assert len(hits) == len(set(hits)) and set(hits) == brute([(k, t or "") for k, t in texts], needles)


def test_a_long_needle_does_not_lengthen_pieces(spark, monkeypatch):
    """Every position carries a bounded piece, whatever the dictionary holds."""
    carried = []
    pieces = containment.text_pieces

    def seen(*given):
        made = pieces(*given)
        carried.append(made.agg(F.max(F.length("_text"))).first()[0])
        return made

    monkeypatch.setattr(containment, "text_pieces", seen)
    texts = spark.createDataFrame([(1, "ab" * 20_000)], "k long, t string")
    needles = spark.createDataFrame([("z" * 10_000,), ("ba",)], "n string")
    assert find_in_texts(texts, "t", needles, "n").count() == 19_999
    assert max(carried) <= 2 * containment.ANCHOR
