"""A corpus from raw documents to token ids, stage by stage.

Every stage takes what its predecessor kept, in the columns of ``documents``, and calls one
operator; the stages are written down one after another, so a lost executor costs one stage at
most. Ids are those of ``documents`` throughout. Null texts, null ids, repeated rows and empty
tables are handled as each operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, language_id, line_dedup, mixing, simhash_dedup
from plumbline.llm.queries import BLOCK, ENCODED, held_out, prepare
from plumbline.operators.staging import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document with a smaller share of its letters in words of known languages is rejected.
SURE = 0.5


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no known language: null, without a letter, or with less than half of the
    letters in words that fit their span's language (``language_id.Reader.fits``). Texts in
    several known languages stay, whichever leads. ``lang`` becomes the predicted language."""
    prepare(spark)
    model = language_id.learn(docs.where(~held_out()))
    told = language_id.predict(docs.select(*COLUMNS), model, also_known=True)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("known") >= SURE)
    return told.where(known).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out. A document that had words and has none left goes."""
    prepare(spark)
    cleaned = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (mixing.n_words(F.col("text")) == 0)
    kept = cleaned.where(~emptied).withColumn("n_chars", F.char_length("text").cast("bigint"))
    return kept.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    prepare(spark)
    return simhash_dedup.keep_one(docs, shingle=3, radius=3).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each pass over a document, so a document may
    come twice, once, in part or not at all."""
    prepare(spark)
    mixed = mixing.mixed_texts(docs, block=BLOCK)
    return mixed.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text they decode to."""
    prepare(spark)
    coded = byte_bpe.round_trip(docs, public_tokenizers.path(ENCODED))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "ids_sha256", "decoded_sha256"
    )


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The language model, the fingerprints and the tokenizer have no SQL form; a test holds ``run``
#: against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
