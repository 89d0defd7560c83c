"""The whole pipeline against plain versions of its stages, and its behaviour on odd tables."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import byte_bpe, language_id, mixing
from plumbline.llm.queries import BLOCK, ENCODED, documents, held_out, prepare
from plumbline.operators.staging import stage

from .test_near_copies import plain_components, plain_lines, plain_mark

SF = "/root/testdata/sf0.001"
WORK = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect()]


def test_stages_are_the_agreed_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "byte_bpe"]


def test_run_equals_plain_stages(spark):
    prepare(spark)
    docs = documents(spark, SF)
    model = language_id.learn(docs.where(~held_out()))
    reader = language_id.Reader(model, 8.0)
    plain = []
    for doc_id, text, _, source, _ in rows_of(docs):
        lang, _, _, known = reader.judge_known(text or "")
        if lang != "und" and known >= corpus_pipeline.SURE:
            plain.append((doc_id, text, lang, source))
    assert sorted((r[0], r[2]) for r in rows_of(WORK["language_id"](spark, docs, SF))) == sorted((r[0], r[2]) for r in plain)

    cleaned = plain_lines([(r[0], r[1]) for r in plain])
    plain = [
        (i, cleaned[i][0], lang, s) for i, t, lang, s in plain
        if not (cleaned[i][1] and not cleaned[i][0].split())
    ]
    marks = [(r[0], plain_mark(r[1])) for r in plain]
    plain = [r for r, group in zip(plain, plain_components(marks)) if r[0] == group]

    # The mix itself is held against SQL elsewhere; here its texts must be words of these.
    sizes = {}
    for r in plain:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].encode().split())
    frame = spark.createDataFrame([(*r, len(r[1])) for r in plain], docs.schema)
    mixed = stage(WORK["mixing"](spark, frame, SF), "plain-mixed").collect()
    own = {r[0]: r[1].encode().split() for r in plain}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(frame, block=BLOCK).collect()}
    words = {}
    for r in mixed:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
        assert set(r["text"].encode().split()) <= set(own[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert words == {d: t for d, t in taken.items() if t}

    ranks = byte_bpe.read_ranks(public_tokenizers.path(ENCODED))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in mixed:
        ids = np.array(library.encode_ordinary(r["text"]), dtype="<u4")
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_texts_in_several_known_languages_stay(spark, docs):
    """Also texts in one of several that are nearly alike; texts in no known language go."""
    en, fr = "the house and this other thing with many words", "le chat est dans une maison avec les autres"
    de, near = "der hund ist nicht auf dem weg nach haus", "mali stol dobar dan kuca velika noc"
    labelled = [(f"{en} {i}", "en") for i in range(40)] + [(f"{fr} {i}", "fr") for i in range(40)] + [(de, "de")] * 40
    labelled += [(near, "bs"), (near, "hr"), (f"{near} lepa", "sr")] * 40
    frame = docs(
        *((100 + i, *row) for i, row in enumerate(labelled)),
        (1, f"{en} {en}\n{fr} {fr}\n{de} {de}"), (2, f"{near} " * 30), (3, "zqxv kjwq pzzf vvkq " * 20), (4, "漢字 仮名 " * 20),
        (5, en + " zqxv kjwq" * 40), (6, en),
    )
    kept = {r["doc_id"] for r in WORK["language_id"](spark, frame, SF).collect()}
    assert {1, 2, 6} <= kept and not kept & {3, 4, 5} and len(kept) == 3 + len(labelled)


ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "12 % 34", "en", None), (4, "the and that was", "en", "a"),
    (4, "the and that was", "en", "a"), (None, "of the with erthat", None, "a"), (None, None, None, None),
    (5, "the and that was", "en", "b"), (6, "word " * 30_000, "en", "b"), (7, "the and\nof was ther\nthe and", "en", "b"),
]


def test_odd_rows_pass_every_stage(spark, docs):
    frame = docs(*ODD)
    for _, work in corpus_pipeline.STAGES:
        frame = stage(work(spark, frame, SF), "odd")
    assert 0 < frame.count() and frame.where(F.col("doc_id").isin(1, 2, 3)).count() == 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_tables_pass_every_stage(spark, docs, name):
    assert WORK[name](spark, docs("x").where(F.lit(False)), SF).count() == 0


def test_all_but_the_last_stage_keep_the_columns(spark, docs):
    for name in list(WORK)[:-1]:
        assert WORK[name](spark, docs("the and that", "of was"), SF).columns == corpus_pipeline.COLUMNS
