"""Languages of texts and of the spans within them.

A model is learned from labelled texts: log-probabilities of letter n-grams of words, and the
scripts each language is written in. A word's script leaves the languages that use it as
candidates; its n-grams score them. A Viterbi path over the words, with a penalty for each change of
language, cuts a text into spans. The language that has most letters is the text's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .batches import SLICE, map_rows

UNKNOWN = "und"

# First code points of blocks and the script of their letters.
SCRIPT_STARTS = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"),
    (0x0780, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1CC0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Han"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
_STARTS = [s for s, _ in SCRIPT_STARTS]
_SCRIPTS = [name for _, name in SCRIPT_STARTS]

#: Runs of letters with their marks.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
#: The same in lower-case ASCII texts.
ASCII_WORDS = re.compile(r"[a-z]+").findall
LONGEST = 3
#: How far below the best language a word may put another; also the score of non-candidates.
FLOOR = 12.0
#: Words remembered by a worker; forgotten all at once when full.
REMEMBERED = 300_000
#: Words of texts, and letters of new words, that are looked at together; a longer one is by itself.
WORDS_AT_ONCE, LETTERS = 1 << 16, 1 << 14


def script(word: str) -> str:
    """Script of a word's first letter, by block."""
    at = bisect_right(_STARTS, ord(word[0])) - 1
    return _SCRIPTS[at] if at >= 0 else "Other"


def grams(word: str) -> list[str]:
    """Letter n-grams of a word between boundary marks, one to three long."""
    marked = f"^{word}$"
    return [*word, *(marked[i : i + n] for n in range(2, LONGEST + 1) for i in range(len(marked) - n + 1))]


def words_of(text: str) -> list[str]:
    """Words of a text in lower case."""
    lower = text.lower()
    return (ASCII_WORDS if lower.isascii() else WORDS)(lower)


@dataclass(frozen=True)
class Model:
    """``weights`` has a row of log-probabilities, one for each language, and ``rows`` tells which
    one an n-gram has; ``scripts`` holds the languages of a script, and ``unmet`` what an n-gram
    weighs that a language never had."""

    languages: list[str]
    rows: dict[str, int]
    weights: np.ndarray
    scripts: dict[str, np.ndarray]
    unmet: np.ndarray


# -- learning ------------------------------------------------------------------------------


def _sample(labelled: DataFrame, lang: str, text: str, doc_id: str, per_language: int) -> DataFrame:
    """About ``per_language`` labelled texts of each language, chosen by a hash of id and text,
    so that rows without an id are drawn like others: the share that gives that many on average,
    all when there are fewer. Rows equal in both are drawn together."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)), F.lit(1_000_000)).alias("draw"),
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    share = F.lit(1_000_000 * per_language) / F.col("rows")
    # One row per language, fewer than the model itself holds: broadcast, so no text is shuffled.
    return rows.join(F.broadcast(sizes), "lang").where(F.col("draw") < share).select("lang", "text")


def learn(
    labelled: DataFrame,
    lang: str = "lang",
    text: str = "text",
    doc_id: str = "doc_id",
    per_language: int = 2000,
    least: int = 3,
) -> Model:
    """A model from rows with a text and a language; others are passed over.

    The sample is bounded by ``per_language`` texts on average, and so is the table of n-grams
    that comes to the driver; n-grams met fewer than ``least`` times in it count as unseen. No
    labelled rows give a model without languages.
    """
    rows = _sample(labelled, lang, text, doc_id, per_language)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE).to_pydict()
                for name, body in zip(part["lang"], part["text"]):
                    for word, times in Counter(words_of(body)).items():
                        seen[name, True, script(word)] += times
                        for gram in grams(word):
                            seen[name, False, gram] += times
        told = [{"lang": k[0], "script": k[1], "item": k[2], "times": n} for k, n in seen.items()]
        if told:
            yield pa.RecordBatch.from_pylist(told, schema=schema)

    kind = "lang string, script boolean, item string, times bigint"
    schema = to_arrow_schema(T.StructType.fromDDL(kind))
    found = rows.mapInArrow(count, kind).groupBy("lang", "script", "item").agg(F.sum("times").alias("times"))
    found = found.where(F.col("script") | (F.col("times") >= least)).collect()

    languages = sorted({r["lang"] for r in found if r["script"]})
    place = {name: i for i, name in enumerate(languages)}
    width = len(languages)
    total, letters = np.zeros(width), np.zeros(width)
    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for row in found:
        table = scripts if row["script"] else counts
        at = place[row["lang"]]
        table.setdefault(row["item"], np.zeros(width))[at] += row["times"]
        (letters if row["script"] else total)[at] += row["times"]
    size = max(len(counts), 1)
    base = np.log(total + 0.5 * size)
    rows = {gram: at for at, gram in enumerate(sorted(counts))}
    met = np.array([counts[gram] for gram in rows]).reshape(len(rows), width)
    uses = {s: c >= 0.01 * np.maximum(letters, 1) for s, c in scripts.items()}
    return Model(languages, rows, (np.log(met + 0.5) - base).astype(np.float32), uses, np.log(0.5) - base)


# -- reading -------------------------------------------------------------------------------


def _key(gram: str) -> int:
    """An n-gram as a number: 21 bits for each code point, and no code point is zero."""
    key = 0
    for letter in gram:
        key = key << 21 | ord(letter)
    return key


def _all_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of what ``grams`` gives for each word, word after word; whether each is longer than a
    letter; where each word's begin; and the words' first code points."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    marked = f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(marked, dtype="<u4").astype(np.int64)
    begins = np.cumsum(sizes + 2) - sizes - 2
    starts = np.cumsum(3 * sizes + 1) - 3 * sizes - 1
    size = np.repeat(sizes, sizes + 2)
    place = np.arange(len(codes)) - np.repeat(begins, sizes + 2)  # in the marked word
    start = np.repeat(starts, sizes + 2)
    keys = np.empty(int((3 * sizes + 1).sum()), dtype=np.int64)
    longer = np.ones(len(keys), dtype=bool)
    one = np.nonzero((place >= 1) & (place <= size))[0]
    two = np.nonzero(place <= size)[0]
    three = np.nonzero(place < size)[0]
    at = (start + place)[one] - 1
    keys[at], longer[at] = codes[one], False
    keys[(start + size + place)[two]] = codes[two] << 21 | codes[two + 1]
    keys[(start + 2 * size + 1 + place)[three]] = codes[three] << 42 | codes[three + 1] << 21 | codes[three + 2]
    return keys, longer, starts, codes[begins + 1]


def _parts(items: Iterable, most: int) -> Iterator[list]:
    """The items in order, in lists whose lengths add up to ``most`` or that hold a single item."""
    part, total = [], 0
    for item in items:
        if part and total + len(item) > most:
            yield part
            part, total = [], 0
        part.append(item)
        total += len(item)
    if part:
        yield part


class Reader:
    """Scores words, remembers them, finds the path."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        width = len(model.languages)
        self.places: dict[str, int] = {}
        self.scores = np.zeros((REMEMBERED, max(width, 1)), dtype=np.float32)
        self.fitting = np.zeros((REMEMBERED, max(width, 1)), dtype=bool)
        keys = np.array([_key(gram) for gram in model.rows], dtype=np.int64)
        self.keys = np.sort(keys)
        self.key_rows = np.array(list(model.rows.values()), dtype=np.int64)[np.argsort(keys)]
        # One more row, reached as -1, for n-grams that were not met.
        self.met = np.zeros((len(model.weights) + 1, width), dtype=bool)
        self.met[:-1] = model.weights > model.unmet + 0.5
        none = np.zeros(width, dtype=bool)
        self.users = np.array([model.scripts.get(name, none) for name in ["Other", *_SCRIPTS]])

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        """The model's row of each n-gram, -1 where it has none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_rows[at], -1)

    def look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of scores and of fits for each word.

        Scores are relative to the best candidate and never below ``-FLOOR``. N-grams that were
        not met say nothing, and neither does a word in a script that no language uses.

        A word fits a language whose word it could be: its script is used there and at least half
        of the n-grams of two letters and more were met. That looks at one language at a time;
        how alike others are says nothing."""
        keys, longer, starts, first = _all_grams(words)
        rows = self._rows(keys)
        candidates = self.users[np.searchsorted(_STARTS, first, side="right")]
        counts = np.add.reduceat(rows >= 0, starts, dtype=np.int64)
        raw = np.zeros(candidates.shape, dtype=np.float32)
        some = np.nonzero(counts)[0]
        if len(some):
            raw[some] = np.add.reduceat(self.model.weights[rows[rows >= 0]], (np.cumsum(counts) - counts)[some])
        raw = np.where(candidates, raw, -np.inf)
        best = raw.max(axis=1, keepdims=True, initial=-np.inf)
        mute = ~candidates.any(axis=1)
        raw[mute], best[mute] = 0.0, 0.0
        met = np.add.reduceat(self.met[np.where(longer, rows, -1)], starts, dtype=np.int64)
        fits = (2 * met >= np.add.reduceat(longer, starts, dtype=np.int64)[:, None]) & candidates
        return np.maximum(raw - best, -FLOOR), fits

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        return self.look(words)[0]

    def fits(self, word: str) -> np.ndarray:
        """For each language, whether a word could be one of its words."""
        return self.look([word])[1][0]

    def _recall(self, words: list[str]) -> np.ndarray:
        """Where the words are remembered; no more of them than half of those that can be."""
        new = set(words).difference(self.places)
        if len(self.places) + len(new) > REMEMBERED:
            self.places.clear()
            new = set(words)
        for part in _parts(new, LETTERS):
            begin = len(self.places)
            end = begin + len(part)
            self.scores[begin:end], self.fitting[begin:end] = self.look(part)
            self.places.update(zip(part, range(begin, end)))
        return np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))

    def matrices(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``look`` tells, remembered."""
        scores = np.empty((len(words), self.scores.shape[1]), dtype=np.float32)
        fitting = np.empty(scores.shape, dtype=bool)
        half = REMEMBERED // 2
        for begin in range(0, len(words), half):
            at = self._recall(words[begin : begin + half])
            scores[begin : begin + half], fitting[begin : begin + half] = self.scores[at], self.fitting[at]
        return scores, fitting

    def matrix(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        return self.matrices(words)[0]

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The language of each word on the best path.

        Leaving one language for a stretch costs a change at each of its ends inside the text.
        When no stretch gains that much even with the best other language for each word, staying
        throughout is best; most texts are settled by that. The rest take the full recursion."""
        count, width = scores.shape
        best = int(scores.sum(axis=0, dtype=np.float64).argmax())
        if width == 1:
            return np.zeros(count, dtype=np.int64)
        gain = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
        sums = np.concatenate(([0.0], np.cumsum(gain, dtype=np.float64)))
        inside = (sums - np.minimum.accumulate(sums)).max()
        if inside <= 2 * self.penalty and sums.max() <= self.penalty and sums[-1] - sums.min() <= self.penalty:
            return np.full(count, best, dtype=np.int64)
        rows = scores.tolist()
        value, tops, changed = rows[0], [0], [()]
        for row in rows[1:]:
            top = max(value)
            change = top - self.penalty
            tops.append(value.index(top))
            changed.append([state for state, v in enumerate(value) if v < change])
            value = [(v if v >= change else change) + s for v, s in zip(value, row)]
        path = np.empty(count, dtype=np.int64)
        state = value.index(max(value))
        for at in range(count - 1, -1, -1):
            path[at] = state
            if state in changed[at]:
                state = tops[at]
        return path

    def judge(self, text: str) -> tuple[str, float, int]:
        """Language, confidence and number of spans. The confidence is the language's share of
        the letters, times its probability against the others over the words of its spans (ten
        words' worth of evidence at most). It tells how far one language leads; a text in
        several, or in one of several alike, has a low one, however well it is known."""
        return self.judge_known(text)[:3]

    def judge_known(self, text: str) -> tuple[str, float, int, float]:
        """What ``judge`` tells, and the share of letters in words that fit their span's language."""
        return self.judge_all([text])[0]

    def judge_all(self, texts: list[str]) -> list[tuple[str, float, int, float]]:
        """What ``judge_known`` tells of each text; words of many texts are looked at together."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0, 0, 0.0)] * len(texts)
        told = []
        for part in _parts(map(words_of, texts), WORDS_AT_ONCE):
            scores, fitting = self.matrices([word for words in part for word in words])
            end = 0
            for words in part:
                begin, end = end, end + len(words)
                told.append(self._judge(words, scores[begin:end], fitting[begin:end]))
        return told

    def _judge(self, words: list[str], scores: np.ndarray, fitting: np.ndarray) -> tuple[str, float, int, float]:
        if not words:
            return UNKNOWN, 0.0, 0, 0.0
        path = self.path(scores)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        share = np.bincount(path, weights=sizes, minlength=scores.shape[1])
        winner = int(share.argmax())
        own = scores[path == winner]
        margin = (own - own[:, [winner]]).mean(axis=0, dtype=np.float64) * min(len(own), 10)
        probability = 1.0 / np.exp(np.minimum(margin, 50)).sum()
        spans = int((np.diff(path) != 0).sum()) + 1
        score = float(share[winner] / share.sum() * min(probability, 1.0))
        known = int(sizes[fitting[np.arange(len(path)), path]].sum()) / int(sizes.sum())
        return self.model.languages[winner], score, spans, known

    def spans(self, text: str) -> list[dict]:
        """``(lang, start, end)`` in characters. A span reaches from its first word to the next
        span's; the first begins the text and the last ends it."""
        found = list(regex.finditer(r"\p{L}[\p{L}\p{M}]*", text))
        if not found or not self.model.languages:
            return []
        path = self.path(self.matrix([m.group().lower() for m in found]))
        cuts = [0, *(np.nonzero(np.diff(path))[0] + 1).tolist()]
        starts = [0, *(found[c].start() for c in cuts[1:])]
        return [
            {"lang": self.model.languages[path[c]], "start": s, "end": e}
            for c, s, e in zip(cuts, starts, [*starts[1:], len(text)])
        ]


def _reading(docs: DataFrame, model: Model, penalty: float, text: str, added: str, work) -> DataFrame:
    keep = [c for c in docs.columns if c not in T.StructType.fromDDL(added).names]
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def make():
        reader = Reader(shared.value, penalty)
        return lambda rows: work(reader, rows)

    return map_rows(rows, keep, ["_text"], added, make)


def predict(
    docs: DataFrame, model: Model, text: str = "text", penalty: float = 8.0, also_known: bool = False
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``n_spans`` added (columns of these names are
    replaced), one row per input row. A null text, one without a
    letter, or a model without languages gives ``und`` with score 0. Ties go to the language
    that sorts first. ``also_known`` adds ``known``, the share of letters in words that fit the
    language of their span, whichever it is."""

    def work(reader, rows):
        told = reader.judge_all(rows["_text"])
        made = {
            "lang_pred": [t[0] for t in told],
            "score": [t[1] for t in told],
            "n_spans": [t[2] for t in told],
        }
        return made | ({"known": [t[3] for t in told]} if also_known else {})

    added = "lang_pred string, score double, n_spans int" + ", known double" * also_known
    return _reading(docs, model, penalty, text, added, work)


def label_spans(docs: DataFrame, model: Model, text: str = "text", penalty: float = 8.0) -> DataFrame:
    """``docs`` with ``spans`` added: the spans of each text, none for a text without letters."""

    def work(reader, rows):
        return {"spans": [reader.spans(t) for t in rows["_text"]]}

    kind = "spans array<struct<lang:string,start:int,end:int>>"
    return _reading(docs, model, penalty, text, kind, work)
