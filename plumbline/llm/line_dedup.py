"""Line dedup: an exact set-similarity join of all lines, later matches removed.

A line's tokens are its shingles of five words in lower case (the whole line when it is
shorter). Lines equal but for case are one class, led by its first line. Classes whose sets have a
Jaccard similarity of ``least`` or more match. A line goes when an earlier line, by
document id and place, matches it; whether that earlier line itself stays does not matter.

Tokens are put in one order, rarest first. Sets of size n can only reach the similarity with sets
that share one of the first n - ceil(least n) + 1 tokens (prefix filter), whose sizes are within
the ratio (length filter), and whose shared token lies early enough in both for the rest to
suffice (positional filter). A set also has 64 bits, the parity of its tokens by hash; every bit in which
two sets differ is a token that one of them lacks (bitmap filter). What passes is verified.

Rarity has to tell crowded tokens from others. Counters of bounded number (Misra-Gries) hold every
token with more than one in ``COUNTERS`` of all occurrences; they come last, in order of their
counts. Others come first, by hash. In the search a token is known by 45 bits of its hash, so
candidates may meet by chance. A class is named by 128 bits of the hash of its line, and a candidate
pair is verified on the words themselves.

A crowd of matching lines does not make all its pairs. Where more than ``FEW`` classes share a
token, each is compared with the earliest of them; one that matches is settled, and only classes that are
not look at the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.operators.staging import join_side, settled, stage

from .batches import SLICE

SHINGLE = 5
LEAST = 0.8
COUNTERS = 65_536
#: Classes at a token that are all paired at once.
FEW = 64

#: Bits of a token's hash, and of a token's place in the order, which has room for crowded ones.
TOKEN_BITS, CODE_BITS = 45, 46
#: Lines handled at a time; their numbers share a 64-bit word with codes.
LINES = 1 << (64 - CODE_BITS - 1)

_MIX, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Crowd:
    """Tokens known to be frequent, sorted, and the rank of each by its count, rarest first."""

    tokens: np.ndarray
    ranks: np.ndarray


NO_CROWD = Crowd(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64))


#: Bytes hashed at a time, unless a word is longer.
WINDOW = 1 << 21
#: Words are hashed as polynomials of their bytes in this odd number, modulo 2**64.
_BASE = 0x100000001B3
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(WINDOW - 1, _BASE, dtype=np.uint64)])
_BACK = np.cumprod(np.r_[np.uint64(1), np.full(WINDOW - 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)])
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def body_lines(text: str) -> list[bytes]:
    return text.lower().encode().split(b"\n")


def _long_word(word: np.ndarray) -> int:
    """The hash of a word of any length, in windows."""
    total = 0
    for at in range(0, len(word), WINDOW):
        part = word[at : at + WINDOW].astype(np.uint64) + np.uint64(1)
        total += int((part * _POWERS[: len(part)]).sum()) * pow(_BASE, at, 1 << 64)
    return total % (1 << 64)


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words of a buffer from running sums, window by window."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        until = max(int(np.searchsorted(ends, begin + WINDOW, side="right")), at + 1)
        if ends[at] - begin > WINDOW:
            out[at] = _long_word(raw[begin : ends[at]])
        else:
            part = raw[begin : ends[until - 1]].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(part * _POWERS[: len(part)])))
            first = starts[at:until] - begin
            out[at:until] = (sums[ends[at:until] - begin] - sums[first]) * _BACK[first]
        at = until
    return out


def line_tokens(lines: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of lines, repeats included, and the number of each one's line. The
    lines are hashed as one buffer: words from running sums over its bytes, shingles by rolling
    over its words."""
    raw = np.frombuffer(b"\n".join(lines), dtype=np.uint8)
    space = np.concatenate(([True], _SPACE[raw], [True]))
    starts = np.nonzero(space[:-1] & ~space[1:])[0]
    ends = np.nonzero(~space[:-1] & space[1:])[0]
    hashed = _word_hashes(raw, starts, ends)
    line_of = np.searchsorted(np.nonzero(raw == 10)[0], starts)
    counts = np.bincount(line_of, minlength=len(lines))
    begins_of = np.cumsum(counts) - counts
    tokens, of_line, rolled = [], [], hashed
    for size in range(1, shingle + 1):
        if len(hashed) < size:
            break
        if size > 1:
            rolled = rolled[: len(hashed) - size + 1] * _STEP + hashed[size - 1 :]
        if size < shingle:
            begins = begins_of[counts == size]
        else:
            begins = np.nonzero(line_of[: len(rolled)] == line_of[size - 1 :])[0]
        mixed = rolled[begins] + np.uint64(size)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        tokens.append((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(64 - TOKEN_BITS))
        of_line.append(line_of[begins])
    if not tokens:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    return np.concatenate(tokens), np.concatenate(of_line)


def token_sets(lines: list[bytes], crowd: Crowd, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The token sets of lines as codes, one set after another, and where each begins and the
    last ends. A code names a token and is its place in the order, so sets are sorted rarest
    first."""
    if len(lines) > LINES:
        parts = [token_sets(lines[at : at + LINES], crowd, shingle) for at in range(0, len(lines), LINES)]
        sizes = np.concatenate([np.diff(offsets) for _, offsets in parts])
        return np.concatenate([codes for codes, _ in parts]), np.concatenate(([0], np.cumsum(sizes)))
    tokens, of_line = line_tokens(lines, shingle)
    if len(crowd.tokens):
        at = np.minimum(np.searchsorted(crowd.tokens, tokens), len(crowd.tokens) - 1)
        late = crowd.ranks[at] | np.uint64(1 << TOKEN_BITS)
        tokens = np.where(crowd.tokens[at] == tokens, late, tokens)
    keys = np.sort((of_line.astype(np.uint64) << np.uint64(CODE_BITS)) | tokens)
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    offsets = np.searchsorted(keys >> np.uint64(CODE_BITS), np.arange(len(lines) + 1, dtype=np.uint64))
    return (keys & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64), offsets


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, doc_key, text)``. Rows that repeat id and text share a key."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(doc_id).cast("string"), whole).alias("doc_key"),
        whole.alias("text"),
    )


# -- rarity --------------------------------------------------------------------------------


class Counters:
    """Misra-Gries: counts of the tokens met, never more than ``most`` kept for long. When there
    are too many, what the first one too many holds is subtracted from all."""

    def __init__(self, most: int):
        self.most = most
        self.tokens, self.times = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.waiting: list[np.ndarray] = []

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        if sum(map(len, self.waiting)) > 16 * self.most:
            self.merge()

    def merge(self) -> None:
        met, times = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.waiting = []
        every = np.concatenate((self.tokens, met))
        order = np.argsort(every, kind="stable")
        every, times = every[order], np.concatenate((self.times, times))[order]
        first = np.nonzero(np.concatenate(([True], every[1:] != every[:-1])))[0] if len(every) else order
        self.tokens = every[first]
        self.times = np.add.reduceat(times, first) if len(first) else times
        if len(self.tokens) > 4 * self.most:
            self.shrink()

    def shrink(self) -> None:
        if self.waiting:
            self.merge()
        if len(self.tokens) > self.most:
            self.times = self.times - np.partition(self.times, -self.most - 1)[-self.most - 1]
            kept = self.times > 0
            self.tokens, self.times = self.tokens[kept], self.times[kept]


def crowded_tokens(keyed: DataFrame, counters: int = COUNTERS, shingle: int = SHINGLE) -> Crowd:
    """The tokens that may hold more than one in ``counters`` of all occurrences. Each task and
    the driver hold a bounded number; sums of such counters keep the bound."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counters(counters)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                bodies = batch.slice(at, SLICE)["text"].to_pylist()
                seen.add(line_tokens([line for body in bodies for line in body_lines(body)], shingle)[0])
        seen.shrink()
        if len(seen.tokens):
            columns = [pa.array(seen.tokens.astype(np.int64)), pa.array(seen.times)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kind = "token bigint, times bigint"
    schema = to_arrow_schema(T.StructType.fromDDL(kind))
    found = keyed.select("text").mapInArrow(count, kind).groupBy("token").agg(F.sum("times").alias("times"))
    top = found.where(F.col("times") > 1).orderBy(F.col("times").desc(), "token").limit(counters)
    ranked = sorted((row["times"], row["token"]) for row in top.collect())
    tokens = np.array([token for _, token in ranked], dtype=np.uint64)
    order = np.argsort(tokens)
    return Crowd(tokens[order], order.astype(np.uint64))


# -- lines, classes, postings --------------------------------------------------------------

_LINE = "doc_key bigint, doc_id bigint, line int, class bigint, check bigint, size int, bits bigint, prefix array<bigint>"


def needed(sizes: np.ndarray, least: float) -> np.ndarray:
    """Tokens that a match has to share with sets of these sizes, at least."""
    return np.ceil(least * sizes - 1e-9).astype(np.int64)


def _lines(keyed: DataFrame, crowd, least: float, shingle: int) -> DataFrame:
    """A row for every line with a word. ``class`` and ``check`` are the halves of a 128-bit hash of
    the line; ``bits`` and ``prefix`` are left out where the task has already told them for the same
    class."""
    schema = to_arrow_schema(T.StructType.fromDDL(_LINE))
    kinds = [field.type for field in schema]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, told = crowd.value, set()
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                bodies = [body_lines(body) for body in part["text"].to_pylist()]
                counts = [len(lines) for lines in bodies]
                every = [line for lines in bodies for line in lines]
                codes, offsets = token_sets(every, common, shingle)
                sizes = np.diff(offsets)
                some = np.nonzero(sizes)[0]
                if not len(some):
                    continue
                names = [xxhash.xxh3_128_digest(every[i]) for i in some.tolist()]
                new = np.empty(len(some), dtype=bool)
                for i, name in enumerate(names):
                    new[i] = name not in told
                    told.add(name)
                if len(told) > 500_000:
                    told.clear()
                document = np.repeat(np.arange(len(bodies)), counts)[some]
                number = (np.arange(len(sizes)) - np.repeat(np.cumsum(counts) - counts, counts))[some]
                sizes, starts = sizes[some], offsets[:-1][some]
                length = np.where(new, sizes - needed(sizes, least) + 1, 0)
                ends = np.cumsum(length)
                values = codes[np.arange(ends[-1]) + np.repeat(starts - ends + length, length)]
                bounds = pa.array(np.concatenate((ends - length, ends[-1:])), type=pa.int32(), mask=np.append(~new, False))
                halves = np.frombuffer(b"".join(names), dtype=np.int64).reshape(-1, 2)
                parity = np.bitwise_xor.reduceat(np.int64(1) << (codes & 63), starts)
                columns = [
                    part["doc_key"].take(pa.array(document)), part["doc_id"].take(pa.array(document)),
                    number, halves[:, 0], halves[:, 1], sizes, pa.array(parity, mask=~new),
                    pa.ListArray.from_arrays(bounds, pa.array(values)),
                ]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c).cast(k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([a.cast(k) for a, k in zip(arrays, kinds)], schema=schema)

    return stage(keyed.select("doc_id", "doc_key", "text").mapInArrow(work, _LINE), "lines")


def _place() -> Column:
    """Order of lines: by document id (nulls first), key of the document, place in it."""
    return F.struct("doc_id", "doc_key", "line")


def _classes(lines: DataFrame) -> DataFrame:
    """``(class, check, first, size, bits, n)``; ``first`` is the first line of the class."""
    classes = lines.groupBy("class", "check").agg(
        F.min(_place()).alias("first"),
        F.first("size").alias("size"),
        F.max("bits").alias("bits"),
        F.count(F.lit(1)).alias("n"),
    )
    return stage(classes, "line-classes")


def _live(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """``(token, first, size, bits, at)``, ``at`` being the token's place in the set, for tokens that more
    than one class has in its prefix.

    Postings are shuffled with half the class hash only; two classes that share it both get its
    postings, which may add a candidate. The postings of a token stream past sorted, one of them held
    back; those that several tasks have told for a class are dropped there but for one. Tokens that
    may be crowded are dealt with by a join that can be split instead.
    """
    spark = classes.sparkSession
    postings = lines.select("class", F.posexplode("prefix").alias("at", "token"))
    kind = "class bigint, at int, token bigint"
    schema = to_arrow_schema(T.StructType.fromDDL(kind))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, in_run = None, False  # the last row so far, and whether the row before shares its token
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).cast(schema)
            if held is not None:
                table = pa.concat_tables([held, table])
            token, of = table["token"].to_numpy(), table["class"].to_numpy()
            again = np.concatenate(([False], (token[1:] == token[:-1]) & (of[1:] == of[:-1])))
            if again.any():
                table, token = table.filter(pa.array(~again)), token[~again]
            same = token[1:] == token[:-1]
            shared = np.concatenate(([in_run], same)) | np.concatenate((same, [False]))
            yield from table.slice(0, len(token) - 1).filter(pa.array(shared[:-1])).to_batches()
            in_run = bool(same[-1]) if len(same) else in_run
            held = table.slice(len(token) - 1)
        if held is not None and in_run:
            yield from held.to_batches()

    late = F.col("token") >= F.lit(1 << TOKEN_BITS)  # codes of crowded tokens
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    streamed = postings.where(~late).repartition(parts, "token").sortWithinPartitions("token", "class").mapInArrow(work, kind)
    met = streamed.unionByName(postings.where(late).select("class", "at", "token").distinct())
    return stage(
        met.join(classes.select("class", "first.*", "size", "bits"), "class").drop("class"), "live-postings"
    )


# -- matching ------------------------------------------------------------------------------


def _may_match(least: float) -> Column:
    """Length, positional and bitmap filter between ``x`` and ``y`` at a shared token."""
    small, large = F.least("x_size", "y_size"), F.greatest("x_size", "y_size")
    shared = least / (1 + least) * (F.col("x_size") + F.col("y_size"))
    rest = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    lacking = F.bit_count(F.col("x_bits").bitwiseXOR(F.col("y_bits")))
    allowed = (1 - least) / (1 + least) * (F.col("x_size") + F.col("y_size"))
    return (small >= least * large - 1e-9) & (rest >= shared - 1e-9) & (lacking <= allowed + 1e-9)


#: What a posting tells of its set, beside the line.
_TOLD = ("size", "bits", "at")


def _sides(postings: DataFrame, name: str, *more: Column) -> DataFrame:
    return postings.select("token", *more, _place().alias(name), *[F.col(c).alias(f"{name}_{c}") for c in _TOLD])


def shingles(words: list[bytes], shingle: int = SHINGLE) -> set:
    """The tokens of a line as the words themselves."""
    if len(words) < shingle:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(shingle))))


def similar(a: set, b: set, least: float) -> bool:
    shared = len(a & b)
    return shared >= least * (len(a) + len(b) - shared) - 1e-9


def _verified(keyed: DataFrame, pairs: DataFrame, least: float, shingle: int) -> DataFrame:
    """The pairs that match, verified on the words of their lines. The texts are read again for just
    the lines that occur; when their list is small enough to be sent to each task, texts are not
    shuffled. Rows that repeat a document tell its lines again, which are folded to one."""
    pairs = stage(pairs.select("x", "y").distinct(), "line-pairs")
    ends = pairs.select(F.col("x").alias("end")).union(pairs.select("y")).distinct()
    wanted = ends.groupBy("end.doc_key").agg(F.collect_list("end.line").alias("wanted"))
    wanted = stage(wanted.withColumnRenamed("doc_key", "_key"), "wanted-lines")
    texts = keyed.join(join_side(wanted), F.col("doc_key") == F.col("_key")).select("doc_id", "doc_key", "text", "wanted")
    kind = "doc_id bigint, doc_key bigint, line int, body binary"
    schema = to_arrow_schema(T.StructType.fromDDL(kind))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = []
                for row in batch.slice(at, SLICE).to_pylist():
                    lines = row["text"].split("\n")
                    for n in sorted(row["wanted"]):
                        body = b" ".join(lines[n].lower().encode().split())
                        rows.append({"doc_id": row["doc_id"], "doc_key": row["doc_key"], "line": n, "body": body})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    told = texts.mapInArrow(find, kind).groupBy(_place().alias("end")).agg(F.first("body").alias("body"))
    told = stage(told, "line-bodies")
    both = pairs.join(told.select(F.col("end").alias("x"), F.col("body").alias("a")), "x")
    both = both.join(told.select(F.col("end").alias("y"), F.col("body").alias("b")), "y").select("x", "y", "a", "b")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets: dict[bytes, set] = {}
                hold = []
                for pair in zip(part["a"].to_pylist(), part["b"].to_pylist()):
                    for body in pair:
                        if body not in sets:
                            sets[body] = shingles(body.split(), shingle)
                    hold.append(similar(sets[pair[0]], sets[pair[1]], least))
                yield part.select(["x", "y"]).filter(pa.array(hold, type=pa.bool_()))

    return both.mapInArrow(verify, both.select("x", "y").schema)


def _matched(keyed: DataFrame, live: DataFrame, least: float, shingle: int) -> DataFrame:
    """``first`` of the classes that match an earlier class. Tokens of few classes (``FEW``) pair them
    all. Where there are more, each is compared with the earliest, and only then those that are not settled with
    the others."""
    lead = F.min(F.struct(_place().alias("x"), *_TOLD))
    tokens = live.groupBy("token").agg(lead.alias("lead"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    marked = stage(live.join(tokens, "token"), "marked-postings")
    few, many = marked.where(F.col("n") <= FEW), marked.where(F.col("n") > FEW)

    own = F.struct(_place().alias("place"), *_TOLD)
    groups = few.groupBy("token").agg(F.collect_list(own).alias("members"))
    ends = groups.select(F.explode("members").alias("q"), "members")
    ends = ends.select("q", F.explode(F.filter("members", lambda m: m["place"] < F.col("q.place"))).alias("p"))
    paired = ends.select(
        *[F.col(f"{side}.{c}").alias(name + suffix) for side, name in (("p", "x"), ("q", "y"))
          for c, suffix in (("place", ""), *((c, f"_{c}") for c in _TOLD))]
    )
    led = _sides(many, "y", F.col("lead.x").alias("x"), *[F.col(f"lead.{c}").alias(f"x_{c}") for c in _TOLD])
    led = led.where(F.col("x") < F.col("y")).select(*paired.columns)
    pairs = paired.unionByName(led).where(_may_match(least))
    done = stage(_verified(keyed, pairs, least, shingle).select(F.col("y").alias("first")).distinct(), "settled")
    if many.isEmpty():
        return done
    open_ = many.join(done, _place() == F.col("first"), "left_anti")
    # Sizes that may match lie in one band of sizes or in neighbouring ones.
    band = F.floor(F.log("size") / -math.log(least)).cast("int")
    theirs = _sides(open_, "y", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    later = (F.col("x") < F.col("y")) & _may_match(least)
    pairs = _sides(many, "x", band.alias("band")).hint("merge").join(theirs, ["token", "band"]).where(later)
    others = _verified(keyed, pairs, least, shingle).select(F.col("y").alias("first"))
    return done.union(others).distinct()


def removed_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, shingle: int = SHINGLE
) -> DataFrame:
    """``(doc_key, removed)``: numbers of the lines (from 0) that an earlier line matches, for the
    documents that have such lines."""
    return settled(docs.sparkSession, "removed-lines", lambda: _removed(_keyed(docs, doc_id, text), least, shingle))


def _removed(keyed: DataFrame, least: float, shingle: int) -> DataFrame:
    spark = keyed.sparkSession
    known = crowded_tokens(keyed, COUNTERS, shingle)
    crowd = spark.sparkContext.broadcast(known)  # bounded by COUNTERS
    lines = _lines(keyed, crowd, least, shingle)
    classes = _classes(lines)
    matched = settled(spark, "matched", lambda: _matched(keyed, _live(lines, classes), least, shingle))
    decided = classes.select("class", "check", "first", "n").join(
        matched.select(F.col("first").alias("_later")), F.col("first") == F.col("_later"), "left"
    )
    repeated = decided.where((F.col("n") > 1) | F.col("_later").isNotNull()).select(
        "class", "check", F.col("first").alias("lead"), F.col("_later").isNotNull().alias("goes")
    )
    repeated = stage(repeated, "repeated-lines")
    gone = lines.join(join_side(repeated), ["class", "check"]).where(F.col("goes") | (_place() != F.col("lead")))
    return gone.groupBy("doc_key").agg(F.collect_set("line").alias("removed"))


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, shingle: int = SHINGLE
) -> DataFrame:
    """``docs`` with the lines that match an earlier one taken out of ``text``, and ``n_lines`` and
    ``n_removed`` added (columns of these names are replaced).

    Lines end at a line feed. Lines without a word are never removed. A null text has no lines
    and stays null; an empty one has one empty line. Rows that repeat id and text are the same
    document and lose the same lines. Null ids come first. Ties go by a hash of the text.
    """
    gone = removed_lines(docs, doc_id, text, least, shingle).withColumnRenamed("doc_key", "_key")
    whole = F.coalesce(F.col(text), F.lit(""))
    own = F.xxhash64(F.col(doc_id).cast("string"), whole)
    breaks = F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n")))
    parts = F.when(F.col("_removed").isNotNull(), F.split(F.col(text), "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_removed"))
    cleaned = F.array_join(F.transform(kept, lambda i: F.col("_parts")[i]), "\n")
    found = docs.withColumn("_own", own).join(join_side(gone.withColumnRenamed("removed", "_removed")), F.col("_own") == F.col("_key"), "left")
    found = found.withColumn("_parts", parts)
    changed = {
        text: F.when(F.col("_removed").isNull(), F.col(text)).otherwise(cleaned),
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(breaks + 1).cast("bigint"),
        "n_removed": F.coalesce(F.size("_removed"), F.lit(0)).cast("bigint"),
    }
    return found.withColumns(changed).drop("_own", "_key", "_removed", "_parts")
