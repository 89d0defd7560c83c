"""Language ID by held-out accuracy and a plain path; mixing by SQL and a plain count."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_id, mixing
from plumbline.llm.queries import SQL, all_queries, documents, held_out, language_model
from workload.check import connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return language_model(documents(spark, SF))


def test_held_out_accuracy(spark):
    rows = all_queries()["op8_language_id"](spark, SF).join(documents(spark, SF).select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    kept_out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in kept_out) >= 0.95 * len(kept_out) > 0


def test_labels_of_held_out_rows_and_other_columns_are_not_read(spark, model):
    blind = documents(spark, SF).withColumn("source", F.lit("s"))
    blind = blind.withColumn("lang", F.when(~held_out(), F.col("lang")).otherwise(F.lit("xx")))
    again = language_model(blind)
    assert again.languages == model.languages and again.rows == model.rows and np.array_equal(again.weights, model.weights)


def test_nothing_to_read(docs, model):
    got = {r["doc_id"]: r for r in language_id.predict(docs(None, "", "12 %%% 3.4", "\n", "漢字", "the and of"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and got[0]["score"] == 0
    assert got[4]["lang_pred"] in model.languages  # letters of a script that says nothing
    nobody = language_id.learn(docs("no label"))
    assert nobody.languages == [] and language_id.predict(docs("text"), nobody).first()["lang_pred"] == "und"
    assert language_id.predict(docs("x").where(F.lit(False)), model).count() == 0


def test_scripts_narrow_the_candidates(docs):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир снова", "ru"), ("hello world again", "en")] * 20)]
    model = language_id.learn(docs(*rows), least=1)
    got = language_id.predict(docs("hello мир мир мир мир", "zzz qqq", "ыыы"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["ru", "en", "ru"]
    spans = language_id.label_spans(docs("hello world again. привет мир снова!"), model, penalty=2.0).first()["spans"]
    assert [(s["lang"], s["start"], s["end"]) for s in spans] == [("en", 0, 19), ("ru", 19, 36)]


def test_rows_without_an_id_are_sampled_like_others(docs):
    frame = docs(*[(None if i % 3 else i, f"text number {i}", "en") for i in range(3000)])
    taken = language_id._sample(frame, "lang", "text", "doc_id", 100)
    assert 60 < taken.count() < 150


@pytest.mark.parametrize("seed", range(30))
def test_path_is_the_best_of_all(model, seed):
    """Against every labelling of up to six words."""
    rng = np.random.default_rng(seed)
    width = len(model.languages)
    scores = -rng.exponential(2.0, size=(rng.integers(1, 7), width)).astype(np.float32)
    reader = language_id.Reader(model, penalty=float(rng.choice([0.5, 2.0, 6.0])))

    def worth(path):
        changes = sum(a != b for a, b in itertools.pairwise(path))
        return sum(float(scores[i, s]) for i, s in enumerate(path)) - reader.penalty * changes

    best = max(map(worth, itertools.product(range(width), repeat=len(scores))))
    assert worth(reader.path(scores).tolist()) == pytest.approx(best, abs=1e-4)


def test_words_are_forgotten_not_confused(model, monkeypatch):
    monkeypatch.setattr(language_id, "REMEMBERED", 8)
    reader = language_id.Reader(model, 8.0)
    words = [f"word{chr(97 + i % 23)}" for i in range(100)]
    assert np.array_equal(reader.matrix(words), np.concatenate([reader.score([w]) for w in words]))


def plain_look(model, word):
    """Scores and fits of a word, n-gram by n-gram."""
    rows = [model.rows.get(g) for g in language_id.grams(word)]
    candidates = model.scripts.get(language_id.script(word), np.zeros(len(model.languages), dtype=bool))
    total = sum((model.weights[r].astype(np.float64) for r in rows if r is not None), np.zeros(len(candidates)))
    scores = np.maximum(np.where(candidates, total, -np.inf) - total[candidates].max(initial=-np.inf), -language_id.FLOOR)
    longer = rows[len(word) :]
    met = sum((model.weights[r] > model.unmet + 0.5 for r in longer if r is not None), np.zeros(len(candidates), dtype=int))
    return scores if candidates.any() else 0.0 * total, (2 * met >= len(longer)) & candidates


def test_words_are_looked_at_as_one_by_one(model):
    words = ["a", "the", "house", "élan", "straße", "मराठी", "мир", "漢", "𐐨𐐩", "zzzzqq", "ǆ", "i̇stanbul", "word" * 9]
    scores, fits = language_id.Reader(model, 8.0).look(words)
    for word, score, fit in zip(words, scores, fits):
        plain_score, plain_fit = plain_look(model, word)
        assert score == pytest.approx(plain_score, abs=1e-3) and fit.tolist() == plain_fit.tolist()
    assert fits.any() and not fits.all()


def test_texts_are_judged_together_as_one_by_one(model, monkeypatch):
    """Also when they are cut into small parts; no word is taken apart by interpreted code."""
    rng = random.Random(5)
    some = ["the", "house", "maison", "und", "nicht", "élan", "мир", "12", "漢字", "-"]
    texts = ["", "12 %"]
    for _ in range(40):
        new = ["".join(rng.choices("abdeñoß", k=rng.randint(1, 9))) for _ in range(20)]
        texts.append(" ".join(rng.choices(some + new, k=60)))
    want = [language_id.Reader(model, 8.0).judge_known(t) for t in texts]
    for word in {w for t in texts for w in language_id.words_of(t)}:
        assert language_id.words_of(word.upper()) == language_id.WORDS(word.upper().lower())
    monkeypatch.setattr(language_id, "grams", None)
    assert language_id.Reader(model, 8.0).judge_all(texts) == want
    monkeypatch.setattr(language_id, "WORDS_AT_ONCE", 100)
    monkeypatch.setattr(language_id, "LETTERS", 7)
    monkeypatch.setattr(language_id, "REMEMBERED", 90)
    assert language_id.Reader(model, 8.0).judge_all(texts) == want
    assert [language_id.Reader(model, 8.0).judge(t) for t in texts] == [w[:3] for w in want]


# -- mixing --------------------------------------------------------------------------------


def test_mixing_query_equals_sql(spark):
    df = all_queries()["op10_mixing"](spark, SF)
    cursor = connect(SF).execute(SQL["op10_mixing"])
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cursor.fetchall())


def plain_targets(sizes, weights=(3, 1, 2)):
    """Share by weight, hold at twice the size, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    given, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            given[s] += left * weight[s] / total
        left = sum(max(0, given[s] - 2 * sizes[s]) for s in open_)
        for s in list(open_):
            if given[s] >= 2 * sizes[s]:
                given[s] = 2 * sizes[s]
                open_.discard(s)
    return given


def mixed_rows(seed, n):
    rng = random.Random(seed)
    names = ["b", "a", None, "é", "Z", "", "c"]
    for at in range(n):
        hot = at % 3 == 0
        text = rng.choice([None, "", " \n", "one", "w " * rng.randint(1, 400), "\tx y  z\n" * rng.randint(1, 60)])
        yield at, text, "en", "hot" if hot else rng.choice(names)


@pytest.mark.parametrize("seed", range(4))
def test_mix_is_near_its_targets(docs, seed):
    rows = list(mixed_rows(seed, 200))
    rows += [(5, "again the same", "en", rows[5][3]), (None, "no id at all", "en", "a")]
    size = {}
    for _, text, _, source in rows:
        size[source] = size.get(source, 0) + len((text or "").encode().split())
    want, block = plain_targets(size), 8
    got = mixing.mix_documents(docs(*rows), block=block).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        map(tuple, mixing.mix_documents(docs(*rows, partitions=7), block=block).collect()), key=repr
    )
    assert len(got) == len(rows)
    assert sorted((r["size"] for r in got)) == sorted(len((t or "").encode().split()) for _, t, _, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    source_of = {i: s for i, _, _, s in rows}
    taken = {}
    for r in got:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == size[source] and r["target"] == pytest.approx(want[source])
        taken[source] = taken.get(source, 0) + r["taken"]
    for source, words in taken.items():
        assert abs(words - want[source]) <= 2 * block


def test_texts_of_the_mix_are_what_it_takes(docs):
    rows = list(mixed_rows(9, 150))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs(*rows), block=8).collect()}
    mixed = mixing.mixed_texts(docs(*rows), block=8)
    assert mixed.columns == docs("x").columns
    words = {}
    for r in mixed.collect():
        own = rows[r["doc_id"]][1]
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
        if len(r["text"].encode().split()) == len(own.encode().split()):
            assert r["text"] == own
        assert set(r["text"].encode().split()) <= set(own.encode().split())
    assert words == {d: t for d, t in taken.items() if t}


def test_blocks_are_permuted_and_shards_drawn(docs, spark):
    rows = [(i, "w " * 640, "en", "a" if i % 3 else "b") for i in range(60)]
    frame = docs(*rows).select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"))
    mix = mixing.Mix(frame, block=64, shards=5)
    for rank, n, passes in mix.targets.select("rank", "n_blocks", "passes").collect():
        for turn in range(passes):
            blocks = [r["block"] for r in mix.slots.where((F.col("rank") == rank) & (F.col("pass") == turn)).collect()]
            assert sorted(blocks) == list(range(n)) and blocks != sorted(blocks)
    counts = mix.shard_counts().collect()
    assert sum(r["n"] for r in counts) == mix.slots.count()
    assert {r["shard"] for r in counts} == set(range(5))


def permutation(spark, n, rank=0, turn=0):
    size = F.lit(n).cast("bigint")
    block = mixing.permuted(F.col("id"), size, mixing._round_keys(size, F.lit(rank).cast("bigint"), turn))
    return [r[0] for r in spark.range(n).select("id", block).orderBy("id").select(block).collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutations(spark, n):
    found = {(rank, turn): permutation(spark, n, rank, turn) for rank in range(2) for turn in range(2)}
    assert all(sorted(blocks) == list(range(n)) for blocks in found.values())
    assert n < 64 or len(set(map(tuple, found.values()))) == 4


def test_permutations_have_no_long_runs(spark):
    """Neighbouring slots are not neighbouring blocks, nor a constant step apart, for any count; and a
    part of a pass draws from all parts of a source."""
    for n in (500, 2187, 4096, 10261):
        blocks = permutation(spark, n)
        steps = [(b - a) % n for a, b in zip(blocks, blocks[1:])]
        assert max(steps.count(s) for s in set(steps[:200])) < 12
        assert sum(s in (1, n - 1) for s in steps) < 12
        first = blocks[: n // 4]
        quarters = [sum(q * n // 4 <= b < (q + 1) * n // 4 for b in first) for q in range(4)]
        assert min(quarters) > 0.15 * len(first) and max(quarters) < 0.35 * len(first)


def test_a_crowd_without_ids_is_spread(docs, monkeypatch):
    """Equal rows are a row for each task in the windows; reruns take the same."""
    monkeypatch.setattr(mixing, "BUCKET", 64)
    rows = [(None, "w " * 20, "en", "a")] * 1500 + [(None, "w " * (i % 90), "en", "a") for i in range(600)] + [(i, "x y", "en", "b") for i in range(50)]
    taken = [sorted(map(tuple, mixing.mix_documents(docs(*rows, partitions=n), block=8).collect()), key=repr) for n in (3, 5)]
    assert taken[0] == taken[1] and len(taken[0]) == len(rows)
    words = sum(t[4] for t in taken[0] if t[2] > 100)
    assert abs(words - next(t[3] for t in taken[0] if t[2] > 100)) <= 16


def test_nothing_to_mix(docs):
    none = docs("x").where(F.lit(False))
    assert mixing.mix_documents(none).count() == 0 and mixing.mixed_texts(none).count() == 0
    blank = docs(None, "", " ")
    assert [r["taken"] for r in mixing.mix_documents(blank).collect()] == [0, 0, 0]
    assert mixing.mixed_texts(blank).count() == 0


def test_native_plan(spark):
    text = all_queries()["op10_mixing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    text += all_queries()["op3_exact_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"):
        assert word not in text
