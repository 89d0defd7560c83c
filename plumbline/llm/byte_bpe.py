"""Byte-level BPE: texts to token ids with character offsets, and back.

The ``tokenizers`` library merges. Its model works on characters, so each byte has a character
that stands for it; a rank file becomes such a model by naming every way to split a token into
two. Texts come as Arrow batches; the distinct pieces of a batch are encoded once, in one call.
Decoding looks every id up in the byte table and joins bytes first: a character may be split
over tokens, and one that is cut off is replaced only in the text, never in the bytes.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from .batches import map_rows
from .pieces import Splitter
from .token_counts import byte_characters

#: Pieces remembered in one generation of a worker's memo; two generations are kept.
REMEMBERED = 60_000


def read_ranks(path: str) -> dict[bytes, int]:
    """``token bytes -> rank``; the rank is the id."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def build_tokenizer(ranks: dict[bytes, int]) -> Tokenizer:
    """The library's model of a rank file. A piece that is a token is taken whole; else any two
    neighbours that make a token merge, lowest rank first."""
    names = byte_characters()
    spell = {token: "".join(names[b] for b in token) for token in ranks}
    merges = [
        (spell[token[:at]], spell[token[at:]])
        for token in sorted(ranks, key=ranks.get)
        for at in range(1, len(token))
        if token[:at] in ranks and token[at:] in ranks
    ]
    vocabulary = {spell[token]: rank for token, rank in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True, cache_capacity=0))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer


def rank_file_members(ranks: dict[bytes, int], pattern: str, text: str) -> str:
    """The characters of ``text`` that match for the library rank files are made for."""
    own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return own.decode(own.encode_ordinary(text))


@dataclass(frozen=True)
class Encoded:
    """Ids of a text and, for each, where its first character starts and its last one ends.
    A character split over tokens is in the span of each of them."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.tokenizer = build_tokenizer(ranks)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length_of = np.array([len(t) for t in self.bytes_of], dtype=np.int64)
        self.pieces = Splitter(lambda pattern, text: rank_file_members(ranks, pattern, text)).split
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces, as bytes of little-endian unsigned 32-bit integers."""
        found, new = {}, []
        for piece in pieces:
            ids = self.young.get(piece) or self.old.get(piece)
            if ids is None:
                new.append(piece)
            else:
                found[piece] = ids
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for piece, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                found[piece] = np.array(coded.ids, dtype="<u4").tobytes()
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young.update((p, ids) for p, ids in found.items() if len(p) <= 64)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        cut = [self.pieces(t) for t in texts]
        known = self.learn(set().union(*cut)) if cut else {}
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def with_offsets(self, text: str, packed: bytes) -> Encoded:
        """Character spans from byte spans: a byte's character is the number of characters
        begun up to it."""
        ids = np.frombuffer(packed, dtype="<u4")
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.length_of[ids])
        starts = ends - self.length_of[ids]
        return Encoded(ids, character[starts] if len(ids) else starts, character[ends - 1] + 1 if len(ids) else ends)

    def packed_offsets(self, text: str, packed: bytes) -> tuple[bytes, bytes]:
        """Starts and ends as bytes of little-endian 32-bit integers."""
        spans = self.with_offsets(text, packed)
        return spans.starts.astype("<i4").tobytes(), spans.ends.astype("<i4").tobytes()

    def decode_bytes(self, packed: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])

    def decode(self, packed: bytes) -> str:
        return self.decode_bytes(packed).decode("utf-8", errors="replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, starts, ends)``: token ids with their character spans, one row per input
    row. A null text is empty and has no tokens."""
    rows = _rows(docs, doc_id, text)

    def make():
        own = codec(path)

        def work(rows):
            coded = [own.with_offsets(t, p) for t, p in zip(rows["text"], own.encode(rows["text"]))]
            return {
                "ids": [c.ids.astype(np.int32) for c in coded],
                "starts": [c.starts.astype(np.int32) for c in coded],
                "ends": [c.ends.astype(np.int32) for c in coded],
            }

        return work

    return map_rows(rows, ["doc_id"], ["text"], "ids array<int>, starts array<int>, ends array<int>", make)


def decode(coded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, bytes, text)`` of rows with token ids; null ids are none. Bytes that are no
    UTF-8 show as U+FFFD in ``text`` only."""
    rows = coded.select(F.col(doc_id).alias("doc_id"), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))

    def make():
        own = codec(path)

        def work(rows):
            raw = [own.decode_bytes(np.array(i, dtype="<u4").tobytes()) for i in rows["ids"]]
            return {"bytes": raw, "text": [r.decode("utf-8", errors="replace") for r in raw]}

        return work

    return map_rows(rows, ["doc_id"], ["ids"], "bytes binary, text string", make)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, starts, ends, ids_sha256, decoded_sha256)``: what ``encode`` and ``decode``
    do, in one pass over each batch. ``ids`` and the character spans are packed, little-endian
    32-bit. ``decoded_sha256`` is that of the text decoded from the ids, as UTF-8."""
    rows = _rows(docs, doc_id, text)

    def make():
        own = codec(path)

        def work(rows):
            packed = own.encode(rows["text"])
            spans = [own.packed_offsets(t, p) for t, p in zip(rows["text"], packed)]
            return {
                "ids": packed,
                "starts": [s for s, _ in spans],
                "ends": [e for _, e in spans],
                "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                "decoded_sha256": [hashlib.sha256(own.decode(p).encode()).hexdigest() for p in packed],
            }

        return work

    added = "ids binary, starts binary, ends binary, ids_sha256 string, decoded_sha256 string"
    return map_rows(rows, ["doc_id"], ["text"], added, make)
