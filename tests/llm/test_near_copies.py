"""Line dedup, SimHash near-dedup and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, simhash_dedup
from plumbline.llm.components import components
from plumbline.llm.queries import all_queries, documents

SF = "/root/testdata/sf0.001"


# -- plain versions ------------------------------------------------------------------------


def plain_tokens(line):
    words = line.lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_lines(rows):
    """``{doc_id: (kept text, removed)}``; every line against all earlier ones."""
    seen, held, out = [], {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            own = plain_tokens(line)
            near = set().union(*(held.get(t, set()) for t in own)) if own else set()
            if not any(len(own & seen[n]) >= 0.8 * len(own | seen[n]) for n in near):
                kept.append(line)
            for token in own:
                held.setdefault(token, set()).add(len(seen))
            seen.append(own)
        out[doc] = ("\n".join(kept), len(lines) - len(kept))
    return out


def plain_mark(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """``[(id, mark)]`` to the least id reachable over at most three different bits."""
    values = np.array([m for _, m in marks], dtype=np.uint64)
    group = list(range(len(marks)))

    def root(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for at in range(len(marks)):
        away = np.unpackbits((values ^ values[at]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
        for other in np.nonzero(away <= 3)[0]:
            group[root(int(other))] = root(at)
    least = {}
    for at, (doc, _) in enumerate(marks):
        if doc is not None:
            least[root(at)] = min(doc, least.get(root(at), doc))
    return [least.get(root(at)) for at in range(len(marks))]


# -- lines ---------------------------------------------------------------------------------


def check_lines(frame, rows):
    got = {r["doc_id"]: (r["text"] or "", r["n_removed"]) for r in line_dedup.dedup_lines(frame).collect()}
    assert got == plain_lines(rows)


def made_up(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    base = [rng.choices(words, k=rng.randint(1, 40)) for _ in range(30)]
    for doc in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line[: len(line) - rng.randint(0, 1)]))
        yield doc * 2, "\n".join(lines)


@pytest.mark.parametrize("counters", [65_536, 5])
def test_lines_equal_brute_force(docs, monkeypatch, counters):
    """With few counters only the most frequent tokens are known as such."""
    monkeypatch.setattr(line_dedup, "COUNTERS", counters)
    monkeypatch.setattr(line_dedup, "FEW", min(counters, 64))
    rows = list(made_up(counters, 150))
    check_lines(docs(*rows), rows)


def test_awkward_lines(docs):
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, "a b c"), (5, "A  b\tc\nx"), (6, "c b a"), (7, "x\n"), (8, "w " * 50_000),
        (9, "w " * 50_001 + "\nlast"), (10, "é É\r"), (None, "c b a"), (12, "\n".join(["same"] * 500)), (0, "last"),
    ]
    check_lines(docs(*rows), rows)


def test_repeated_rows_lose_the_same_lines(docs):
    rows = docs((1, "p q\nr s"), (1, "p q\nr s"), (2, "r s"), (2, "r s"))
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(rows).collect())
    assert got == [(1, "p q\nr s", 0)] * 2 + [(2, "", 1)] * 2


def test_lines_whose_hashes_meet_are_told_apart(docs):
    """The tokens of these two lines share their 45 bits."""
    rows = [(1, "item 4782700"), (2, "item 7605754")]
    tokens, _ = line_dedup.line_tokens([text.encode() for _, text in rows])
    assert len(set(tokens.tolist())) == 1
    check_lines(docs(*rows), rows)


def test_many_copies_of_a_row_are_one_document(docs):
    words = [f"w{i}" for i in range(30)]
    near = " ".join(words[:-1])
    rows = docs(*[(1, " ".join(words))] * 1500, *[(2, near + "\nown line")] * 1500, *[(None, None)] * 1500)
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(rows).collect()}
    assert got == {(1, " ".join(words), 0), (2, "own line", 1), (None, None, 0)}


def test_unlike_lines_with_a_common_phrase(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 4)
    rng = random.Random(4)
    phrase = "all rights are reserved here"
    rows = [(i, f"{phrase} " + " ".join(str(rng.random()) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    check_lines(docs(*rows), rows)


def test_line_query_equals_brute_force(spark):
    import hashlib

    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).select("doc_id", "text").collect()]
    want = {d: (t.count("\n") + 1, w[1], hashlib.sha256(w[0].encode()).hexdigest()) for (d, t), w in
            ((r, plain) for r in rows for plain in [plain_lines_of(rows)[r[0]]])}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text_sha256"]) for r in all_queries()["op7_line_dedup"](spark, SF).collect()}
    assert got == want


_known = {}


def plain_lines_of(rows):
    if not _known:
        _known.update(plain_lines(rows))
    return _known


def test_counters_keep_every_frequent_token():
    seen = line_dedup.Counters(5)
    for at in range(300):
        seen.add(np.array([7, 7, 7, *range(100 + at * 9, 109 + at * 9)], dtype=np.uint64))
    seen.shrink()
    assert 7 in seen.tokens.tolist() and len(seen.tokens) <= 5


def test_word_hashes_do_not_depend_on_windows(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcé\u6f22 ", k=rng.randint(1, 9))) for _ in range(4000)] + ["x" * 9000]
    rng.shuffle(words)
    lines = " ".join(words).replace("aa", "\n").encode().split(b"\n")
    whole = line_dedup.line_tokens(lines)
    one_by_one = [line_dedup.line_tokens([line])[0].tolist() for line in lines]
    monkeypatch.setattr(line_dedup, "WINDOW", 64)
    again = line_dedup.line_tokens(lines)
    assert np.array_equal(whole[0], again[0]) and np.array_equal(whole[1], again[1])
    grouped = [[] for _ in lines]
    for token, line in zip(whole[0].tolist(), whole[1].tolist()):
        grouped[line].append(token)
    assert [sorted(g) for g in grouped] == [sorted(o) for o in one_by_one]


def test_codes_name_tokens_and_sort_crowded_ones_last():
    lines = [b"a b c d e f", b"", b"x", b"a b c d e", b"a b c d e f a b c d e f", b"x " * 9]
    plain, at = line_dedup.token_sets(lines, line_dedup.NO_CROWD)
    assert np.diff(at).tolist() == [2, 0, 1, 1, 6, 1]
    crowd = line_dedup.Crowd(np.sort(plain[:2].astype(np.uint64)), np.array([1, 0], dtype=np.uint64))
    codes, again = line_dedup.token_sets(lines, crowd)
    assert again.tolist() == at.tolist() and (codes[:2] >> line_dedup.TOKEN_BITS).tolist() == [1, 1]
    assert set(codes[:2]) < set(codes[at[4] : at[5]])


# -- fingerprints --------------------------------------------------------------------------


def cloud(seed, n, bits):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(5)]
    return sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(bits), rng.randint(0, 4))) for _ in range(n)})


@pytest.mark.parametrize("crowd", [256, 8, 1])
@pytest.mark.parametrize("bits", [10, 64])
def test_links_join_what_all_pairs_join(spark, crowd, bits):
    marks = cloud(crowd, 250, bits)
    signed = [m - 2**64 if m >> 63 else m for m in marks]
    frame = spark.createDataFrame([(m,) for m in signed], "mark long")
    links = simhash_dedup.near_links(frame, crowd=crowd).distinct()
    for a, b in links.collect():
        assert ((a ^ b) % 2**64).bit_count() <= 3
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    want = plain_components(list(enumerate(marks)))
    pairs = {(roots.get(s, s), w) for s, w in zip(signed, want)}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


AWKWARD = [
    None, "", " \t", "one", "One", "one two", "É é", "a b c d", "x " * 40_000, "x " * 40_000, "the same text over and over",
    "THE same text over and over", "漢 字 か な",
]


def test_near_duplicates_equal_brute_force(docs):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choices(words, k=400))
    edits = []
    for _ in range(40):
        own = base.split()
        own[rng.randrange(400)] = rng.choice(words)
        edits.append(" ".join(own))
    rows = [(i * 7 % 101, t) for i, t in enumerate([*AWKWARD, base, base.upper(), *edits])] + [(None, "alone with no id"), (None, base)]
    marks = [(i, plain_mark(t)) for i, t in rows]
    want = sorted(zip((i for i, _ in rows), (f"{m:016x}" for _, m in marks), plain_components(marks)), key=repr)
    got = simhash_dedup.near_duplicates(docs(*rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want
    kept = simhash_dedup.keep_one(docs(*rows))
    groups = {c for _, _, c in want if c is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(groups)


def test_one_of_repeated_rows_stays(docs):
    kept = simhash_dedup.keep_one(docs((1, "p q r s"), (1, "p q r s"), (2, "p q r s"), (3, "other words in here")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_one_row_of_each_component_stays_whatever_its_id(docs):
    """Null ids in a component with an id, alone and together; an id used by different texts."""
    rows = [
        (1, "p q r s"), (None, "p q r s"), (None, "alone with no id"), (None, "also alone but of other words"),
        (None, "two rows that have no id"), (None, "two rows that have no id"), (2, "leads one text of its own"),
        (2, "and leads quite another text too"), (2, "P q r s"), (3, "dropped for the smaller id"), (0, "dropped for the smaller id"),
        (3, "yet the only one of these words"),
    ]
    marks = [plain_mark(t) for _, t in rows]
    assert all((a ^ b).bit_count() > 3 for a in set(marks) for b in set(marks) if a != b)
    want = {}
    for (doc, _), mark in zip(rows, marks):
        want[mark] = min(want.get(mark, (True, 0)), (doc is None, doc or 0))
    kept = simhash_dedup.keep_one(docs(*rows))
    assert kept.columns == docs("x").columns
    got = sorted((plain_mark(r["text"]), (r["doc_id"] is None, r["doc_id"] or 0)) for r in kept.collect())
    assert got == sorted(want.items())


def test_near_dedup_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF).select("doc_id", "text").collect()]
    marks = [(i, plain_mark(t)) for i, t in rows]
    want = {i: (f"{m:016x}", c) for (i, m), c in zip(marks, plain_components(marks))}
    got = all_queries()["op9_simhash_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_components_of_paths_stars_and_rings(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    ring = [(5000 + i, 5000 + (i * 7 + 7) % 49) for i in range(49)]
    edges = spark.createDataFrame(path + star + ring + [(9, 9), (8000, 8000)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert len({roots[i] for i in range(201)}) == 1
    assert len({roots[1000 + i] for i in range(300)}) == 1 and len(set(roots.values())) >= 3
    assert 8000 not in roots
    assert components(edges.where(F.lit(False))).count() == 0


def test_empty_tables(docs):
    none = docs("x").where(F.lit(False))
    assert line_dedup.dedup_lines(none).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert simhash_dedup.keep_one(none).count() == 0
