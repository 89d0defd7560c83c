"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q that is ``times`` periods and ``least`` words long
at least and that no neighbouring word extends. Runs longer than that hold, for B the largest power
of two up to q (or the smallest block), an aligned block of B words that occurs again q words later.

The classes of equal blocks of 1, 2, 4, ... words come from prefix doubling, which sorts only
suffixes that are not told apart yet. In the order it ends with, the suffixes that begin with one
block are neighbours, and a wavelet tree over that order answers "the first place after x where this
block occurs" (range successor). Each aligned block asks for its occurrences in the window of two
blocks behind it. Those that overlap by half or more form a progression whose difference d is the
block's own period. A progression of any length gives few candidates: d, and the shifts that lay
the ends of one stretch of period d on the ends of another; by the periodicity lemma no other shift
inside it can be a smallest period. Single occurrences give their distance.

Every candidate is extended both ways by the classes, as a binary search, and kept if it is long
enough. A stretch with several periods keeps the smallest, of which the others are multiples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows

LEAST, TIMES = 24, 3
#: Words handled together; a longer text is handled alone.
WORDS = 1 << 18

_RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>, n_words bigint, collapsed string"


class Successor:
    """A wavelet tree over a permutation: the smallest value of a range that is not below a bound."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for bit in reversed(range(self.bits)):
            low = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(low))))
            values = np.concatenate((values[low], values[~low]))

    def below(self, begin: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range are below its bound."""
        count = np.zeros(len(begin), dtype=np.int64)
        for zeros, bit in zip(self.zeros, reversed(range(self.bits))):
            b, e = zeros[begin], zeros[end]
            high = (bound >> bit) & 1 == 1
            count += np.where(high, e - b, 0)
            begin = np.where(high, zeros[-1] + begin - b, b)
            end = np.where(high, zeros[-1] + end - e, e)
        return count

    def nth(self, begin: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with ``n`` smaller ones in each range."""
        value = np.zeros(len(begin), dtype=np.int64)
        for zeros, bit in zip(self.zeros, reversed(range(self.bits))):
            b, e = zeros[begin], zeros[end]
            high = n >= e - b
            n = np.where(high, n - (e - b), n)
            value |= high.astype(np.int64) << bit
            begin = np.where(high, zeros[-1] + begin - b, b)
            end = np.where(high, zeros[-1] + end - e, e)
        return value


class Texts:
    """Block classes of several texts laid end to end. A word is a class of its own in each text and
    a mark of its own ends each text, so blocks of different texts, or over an end, never meet."""

    def __init__(self, texts: list[np.ndarray], block: int, times: int):
        sizes = np.array([len(t) for t in texts])
        self.ends = np.cumsum(sizes + 1) - 1
        self.begins = self.ends - sizes
        self.block, self.times, self.longest = block, times, int(sizes.max(initial=0))
        symbols = np.zeros(int(sizes.sum()) + len(texts), dtype=np.int64)
        base = 0
        for begin, text in zip(self.begins, texts):
            symbols[begin : begin + len(text)] = text + base
            base += int(text.max(initial=-1)) + 1
            symbols[begin + len(text)] = base
            base += 1
        counts = np.bincount(symbols)
        #: For each power of two, the rank of the first suffix that begins with the same block.
        self.ranks = [(np.cumsum(counts) - counts)[symbols]]
        live = np.nonzero(counts[symbols] > 1)[0]
        while len(live) and 1 << len(self.ranks) <= max(block, self.longest // times):
            live = self._double(live)
        self._order()

    def _double(self, live: np.ndarray) -> np.ndarray:
        """The ranks by blocks of twice the size, and the suffixes that still share theirs."""
        last = self.ranks[-1]
        first, second = last[live], last[live + (1 << (len(self.ranks) - 1))]
        order = np.lexsort((second, first))
        live, first, second = live[order], first[order], second[order]
        at = np.arange(len(live))
        new_class = np.concatenate(([True], first[1:] != first[:-1]))
        new = new_class | np.concatenate(([True], second[1:] != second[:-1]))
        class_at = np.maximum.accumulate(np.where(new_class, at, 0))
        new_at = np.maximum.accumulate(np.where(new, at, 0))
        ranks = last.copy()
        ranks[live] = first + new_at - class_at
        self.ranks.append(ranks)
        alone = new & np.concatenate((new[1:], [True]))
        return live[~alone]

    def _order(self) -> None:
        """The suffixes whose smallest block occurs again, in order, and the tree over it."""
        level = self.block.bit_length() - 1
        self.places = np.empty(0, dtype=np.int64)
        if level < len(self.ranks):
            ranks = self.ranks[level]
            self.places = np.nonzero(np.bincount(ranks, minlength=len(ranks))[ranks] > 1)[0]
        if len(self.places):
            order = np.argsort(self.ranks[-1][self.places], kind="stable")
            self.sorted = self.places[order]
            self.tree = Successor(order)

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on are equal; ``a < b`` in one text."""
        same = np.zeros(len(a), dtype=np.int64)
        for k in reversed(range(len(self.ranks))):
            ranks = self.ranks[k]
            on = ranks[a + same] == ranks[b + same]
            same += on.astype(np.int64) << k
            while k == len(self.ranks) - 1 and on.any():
                on &= ranks[a + same] == ranks[b + same]
                same += on.astype(np.int64) << k
        return same

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` are equal."""
        same = np.zeros(len(a), dtype=np.int64)

        def equal(k: int) -> np.ndarray:
            at = a - same - (1 << k)
            return (at >= 0) & (self.ranks[k][np.maximum(at, 0)] == self.ranks[k][np.maximum(b - same - (1 << k), 0)])

        for k in reversed(range(len(self.ranks))):
            on = equal(k)
            same += on.astype(np.int64) << k
            while k == len(self.ranks) - 1 and on.any():
                on &= equal(k)
                same += on.astype(np.int64) << k
        return same

    def _next(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from ``bound`` on among those that share a block; past all texts if none."""
        dense = np.searchsorted(self.places, bound)
        smaller = self.tree.below(low, high, np.minimum(dense, len(self.places) - 1))
        smaller = np.where(dense == len(self.places), high - low, smaller)
        some = smaller < high - low
        found = self.tree.nth(low, high, np.where(some, smaller, 0))
        return np.where(some, self.places[found], 2 * len(self.ranks[0]) + 2 * self.longest)

    def _candidates(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of aligned blocks, each with a shift that may be a period around it."""
        size = 1 << level
        ranks = self.ranks[level]
        of_text = np.searchsorted(self.ends, self.places)
        aligned = (self.places - self.begins[of_text]) % size == 0
        places = self.places[aligned]
        by_rank = ranks[self.sorted]
        low, high = np.searchsorted(by_rank, ranks[places]), np.searchsorted(by_rank, ranks[places], side="right")
        many = high - low > 1
        j, low, high = places[many], low[many], high[many]
        found = [(j[:0], j[:0])]
        x = self._next(low, high, j + 1)
        own = np.nonzero(x - j <= size // 2)[0]
        if len(own):
            found.append((j[own], (x - j)[own]))
            edge = x[own] + self.after(j[own], x[own])
            x[own] = self._next(low[own], high[own], edge - size + 1)
        while len(j):
            near = x < j + 2 * size
            j, low, high, x = j[near], low[near], high[near], x[near]
            if not len(j):
                break
            y = self._next(low, high, x + 1)
            paired = y - x <= size // 2
            found.append((j[~paired], (x - j)[~paired]))
            at = np.nonzero(paired)[0]
            if len(at):
                jj, xx, yy = j[at], x[at], y[at]
                d = yy - xx
                edge = yy + self.after(xx, yy)
                found.append((jj, (xx - self.before(xx, yy)) - (jj - self.before(jj, jj + d))))
                found.append((jj, edge - (jj + d + self.after(jj, jj + d))))
                y[at] = self._next(low[at], high[at], edge - size + 1)
            x = y
        place, shift = (np.concatenate(part) for part in zip(*found))
        within = (shift > 0) & (shift < 2 * size) & (place + shift < self.ends[np.searchsorted(self.ends, place)])
        return place[within], shift[within]

    def runs(self, least: int) -> np.ndarray:
        """Rows of (text, start, length, period), by text, start and period."""
        found = []
        first = self.block.bit_length() - 1
        for level in range(first, len(self.ranks) if len(self.places) else first):
            place, shift = self._candidates(level)
            start = place - self.before(place, place + shift)
            end = place + shift + self.after(place, place + shift)
            long = end - start >= np.maximum(least, self.times * shift)
            found.append(np.stack((start, end, shift), axis=1)[long])
        if not found or not sum(map(len, found)):
            return np.empty((0, 4), dtype=np.int64)
        every = np.concatenate(found)
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        first_of = np.concatenate(([True], (every[1:, :2] != every[:-1, :2]).any(axis=1)))
        start, end, period = every[first_of].T
        text = np.searchsorted(self.ends, start)
        rows = np.stack((text, start - self.begins[text], end - start, period), axis=1)
        return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def find_runs(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each list of words, its runs as rows of (start, length, period), by start and period."""
    if times < 3 or least < times:
        raise ValueError("runs are of three periods at least")
    block = 1 << ((least // 3).bit_length() - 1)
    numbered = []
    for words in texts:
        numbers = {word: i for i, word in enumerate(dict.fromkeys(words))}
        numbered.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
    out: list[np.ndarray] = []
    at = 0
    while at < len(numbered):
        until, total = at + 1, len(numbered[at])
        while until < len(numbered) and total + len(numbered[until]) <= WORDS:
            total += len(numbered[until])
            until += 1
        rows = Texts(numbered[at:until], block, times).runs(least)
        bounds = np.searchsorted(rows[:, 0], np.arange(until - at + 1))
        out += [rows[b:e, 1:] for b, e in zip(bounds, bounds[1:])]
        at = until
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, without those that a run contains after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.nonzero(np.cumsum(change[:-1]) == 0)[0]
    return b" ".join([words[i] for i in kept.tolist()])


def periodic_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """``(doc_id, runs, n_words, collapsed)``, one row per input row. ``runs`` are structs of start,
    length and period, counted in words, by start and period; ``collapsed`` is what remains when each
    run keeps its first period only, joined by single spaces.

    Words are what ASCII white space divides. A null text is an empty one: no runs, and an empty
    ``collapsed``. Null ids, repeated rows and further columns do not matter; an empty table gives
    none. A text is handled in one task, in memory that grows with its length times its logarithm.
    """

    def make():
        def work(columns):
            texts = [(t or "").encode().split() for t in columns["text"]]
            runs = find_runs(texts, least, times)
            return {
                "runs": [[dict(zip(("start", "length", "period"), row)) for row in found.tolist()] for found in runs],
                "n_words": [len(words) for words in texts],
                "collapsed": [collapsed(words, found).decode() for words, found in zip(texts, runs)],
            }

        return work

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_rows(rows, ["doc_id"], ["text"], _RUNS, make)
