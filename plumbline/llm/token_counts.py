"""Token counts by byte-pair merging, without token ids.

A piece starts as a linked list of its byte symbols. A heap holds the adjacent pairs that have a
rank; the lowest rank, leftmost on ties, is popped and merged, and the two pairs it touches are
looked up again. Every merge makes one symbol of two, so the count is symbols minus merges. The
cost of a piece is n log n, whatever its length.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .batches import map_rows
from .pieces import Splitter

#: Pieces remembered in one generation of a worker's memo; two generations are kept.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the other bytes
    in order from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class MergeTable:
    """Ranks of symbol pairs. Symbols are small integers; bytes are their own."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int]):
        names = byte_characters()
        number = {name: at for at, name in enumerate(names)}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            made = number.setdefault(left + right, len(number))
            self.pairs[number[left], number[right]] = (rank, made)
        missing = {b for b, name in enumerate(names) if name not in vocabulary}
        if missing:
            raise ValueError(f"bytes without a token: {sorted(missing)}")

    def count(self, piece: bytes) -> int:
        """Tokens of one piece."""
        pairs, symbols = self.pairs, list(piece)
        last = len(symbols) - 1
        if last < 1:
            return last + 1
        heap = []
        for at in range(last):
            found = pairs.get((symbols[at], symbols[at + 1]))
            if found:
                heap.append((found[0], at, found[1]))
        if not heap:
            return last + 1
        heapify(heap)
        after, before = list(range(1, last + 2)), list(range(-1, last))
        merged = 0
        while heap:
            _, at, made = heappop(heap)
            right = after[at]
            # Stale entries: the left symbol is gone or its pair has changed since.
            if symbols[at] < 0 or right > last:
                continue
            found = pairs.get((symbols[at], symbols[right]))
            if not found or found[1] != made:
                continue
            merged += 1
            symbols[at], symbols[right] = made, -1
            following = after[at] = after[right]
            if following <= last:
                before[following] = at
                found = pairs.get((made, symbols[following]))
                if found:
                    heappush(heap, (found[0], at, found[1]))
            previous = before[at]
            if previous >= 0:
                found = pairs.get((symbols[previous], made))
                if found:
                    heappush(heap, (found[0], previous, found[1]))
        return last + 1 - merged


def library_members(pattern: str, text: str) -> str:
    """The characters of ``text`` that the tokenizers library finds to match."""
    split = pre_tokenizers.Split(Regex(pattern), behavior="removed").pre_tokenize_str
    found = []
    for at in range(0, len(text), 1024):
        block = text[at : at + 1024]
        others = set("".join(piece for piece, _ in split(block)))
        found.extend(c for c in block if c not in others)
    return "".join(found)


class Counter:
    """Counts the tokens of texts as the tokenizer file says; remembers the pieces it met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        self.table = MergeTable(merges, told["model"]["vocab"])
        added = sorted((t["content"] for t in told.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces = Splitter(library_members).split
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _new(self, piece: str) -> int:
        found = self.old.get(piece)
        if found is None:
            found = self.table.count(piece.encode())
        if len(piece) <= 64:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def plain(self, text: str) -> int:
        known, new, total = self.young.get, self._new, 0
        for piece in self.pieces(text):
            found = known(piece)
            total += new(piece) if found is None else found
            known = self.young.get
        return total

    def count(self, text: str) -> int:
        """A special string inside the text is one token and cuts it, as the library does."""
        if self.special is None:
            return self.plain(text)
        total, at = 0, 0
        for match in self.special.finditer(text):
            total += self.plain(text[at : match.start()]) + 1
            at = match.end()
        return total + self.plain(text[at:] if at else text)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per worker process and file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row.

    ``path`` is a byte-level BPE tokenizer file that every worker can read. A null text counts
    as empty: no bytes, no tokens. Repeated rows are counted each.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    def make():
        count = counter(path).count
        return lambda rows: {
            "n_bytes": [len(t.encode()) for t in rows["text"]],
            "n_tokens": [count(t) for t in rows["text"]],
        }

    counted = map_rows(rows, ["doc_id"], ["text"], "n_bytes bigint, n_tokens bigint", make)
    return counted.withColumn("over_limit", over(F.col("n_tokens"), limit))


def over(tokens: Column, limit: int) -> Column:
    return tokens > F.lit(limit)
