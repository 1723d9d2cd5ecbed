"""Near copies, repeated bytes and pieces against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from regimeweave.llm import ngram_join, pieces, repeats

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[RNG.randrange(len(w))] = RNG.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    base = [sentence(RNG.randint(60, 200)) for _ in range(12)]
    texts = [edited(b, RNG.randint(0, 6)) for b in base for _ in range(6)]
    texts += [base[0], base[0], "one two", "one two", "one", "", None, "é " + base[1], base[2] + "\n" + base[3], "ab" * 900, " x" * 700]
    return [(i, t, "extra") for i, t in enumerate(texts)] + [(3, "repeated id", "x"), (None, base[5], "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shingles string")


def test_near_copies(spark, docs, rows):
    got = ngram_join.near_copies(docs).collect()
    assert len(got) == len(rows)
    sets = []
    for _, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links = defaultdict(int)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and 10 * len(a & b) >= 8 * len(a | b):
                links[i] += 1
    want = sorted((str(r[0]), links[i]) for i, r in enumerate(rows) if r[0] is not None)
    assert sorted((str(r.doc_id), r.n_links) for r in got if r.doc_id is not None) == want
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() < len(rows)
    assert ngram_join.near_copies(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark, rows):
    """Repeated and null ids: a row goes only with its own group, and every group keeps one row."""
    same, alone = sentence(80), sentence(80)
    odd = [(None, edited(same, 1), "x"), (None, edited(same, 1), "y"), (200, same, "p"), (200, edited(same, 2), "q"), (200, alone, "r")]
    nulls = sentence(90)
    odd += [(None, nulls, "a"), (None, edited(nulls, 2), "b"), (201, alone + " end", "t"), (202, "w " + nulls[::-1], "u"), (202, "w " + nulls[::-1], "v"), (203, alone, "r")]
    table = spark.createDataFrame([*rows, *odd], "doc_id long, text string, shingles string")
    given = [tuple(r) for r in table.selectExpr("doc_id", "text", "shingles", "xxhash64(text)").collect()]
    sets = []
    for _, text, _, _ in given:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(given)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    members = defaultdict(list)
    for g, r in zip(group, given, strict=True):
        members[g].append(r)
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    want = sorted(str(min(m, key=order)[:2]) for m in members.values())
    got = ngram_join.drop_near_copies(table).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == want
    assert set(map(tuple, got)) <= {r[:3] for r in given}


def test_blocks_and_recall():
    lengths = ngram_join.prefix_lengths()
    k = lengths[-1]
    assert 1 - (1 - 0.8**k) ** ngram_join.TREES >= ngram_join.TARGET_RECALL and lengths[0] == ngram_join.DEPTH
    a = [np.unique(np.array(RNG.sample(range(60), 30), np.uint64)) for _ in range(20)]
    b = [np.unique(np.array(RNG.sample(range(60), 30), np.uint64)) for _ in range(15)]
    linked = ngram_join.compare(a, b, 0.4)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            both = len(np.intersect1d(x, y))
            assert linked[i, j] == (both * 10 >= 4 * (len(x) + len(y) - both))


@pytest.mark.parametrize("size", [4, 20_000, 60_001])
def test_ties_at_the_threshold_are_links(size):
    """``9 * common = 4 * (a + b)`` links, one shingle less does not, whatever the size."""
    both = 4 * size
    a = np.arange(both + size // 2, dtype=np.uint64)
    b = np.r_[np.arange(both), 10**9 + np.arange(size - size // 2)].astype(np.uint64)
    assert ngram_join.compare([a], [b], 0.8)[0, 0]
    assert not ngram_join.compare([a], [np.r_[b, 10**12].astype(np.uint64)], 0.8)[0, 0]


def removed_by_definition(rows):
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` by a table of all strings of 400 bytes."""
    texts = [(r[1] or "").encode() for r in rows]
    seen = defaultdict(list)
    for i, b in enumerate(texts):
        for p in range(len(b) - 399):
            seen[b[p : p + 400]].append((i, p))
    gone = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + 400))
    want = []
    for i, b in enumerate(texts):
        kept = bytes(x for k, x in enumerate(b) if k not in gone[i])
        spans = sum(1 for k in gone[i] if k - 1 not in gone[i])
        want.append((str(rows[i][0]), len(b), len(gone[i]), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(want)


def test_repeated_bytes(docs, rows):
    got = repeats.repeated_spans(docs).collect()
    want = removed_by_definition(rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(w[2] for w in want) > 0
    assert repeats.repeated_spans(docs.limit(0)).count() == 0


def test_passages_about_as_long_as_the_limit(spark):
    """Shared passages of 380 to 900 bytes at any place, inside other repeated passages, at both ends, twice in a text, and periodic ones."""
    noise = lambda n: "".join(RNG.choice("abcdefgh ") for _ in range(n))
    passages = [noise(n) for n in (380, 399, 400, 401, 410, 431, 432, 500, 611, 900)]
    texts = []
    for p in passages:
        for _ in range(3):
            texts.append(noise(RNG.randint(0, 300)) + p + noise(RNG.randint(0, 300)))
    texts += [p[RNG.randint(0, 40) :] + noise(20) + p for p in passages] + [passages[9][100:650], passages[9][:520] + "z" + passages[9][300:]]
    texts += ["ab" * 350 + noise(5), noise(9) + "ab" * 300, "q" * 401, "q" * 400, noise(130) * 5, passages[8] + passages[8][:395]]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed_by_definition(rows)


def every_path(lattice, chunk):
    out = []

    def go(i, score, ids):
        if i == len(chunk):
            out.append((score, ids))
            return
        b = chunk[i]
        char = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        for x in lattice.lengths:
            if i + x <= len(chunk):
                piece = lattice.by_surface.get(chunk[i : i + x])
                if piece:
                    go(i + x, score + piece[1], (*ids, piece[0]))
                elif x == char:
                    go(i + x, score + lattice.v.unknown, ids + tuple(lattice.v.byte_ids[list(chunk[i : i + x])].tolist()))

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the cat", "a b\nc é", "  xyz", "", "日本 x", "▁q", "\n\n", "tab\there"])
def test_nbest_against_every_path(text):
    lattice = pieces.Lattice(pieces.Vocabulary.load())
    raw = text.encode()
    e = pieces.encode_texts(pieces.Memory(lattice), np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 4)
    want = every_path(lattice, b" " + raw)
    assert e.scores[0] == [s for s, _ in want[:4]]
    best = tuple(e.ids.tolist())
    paths = {best}
    for edits in e.edits[0]:
        ids = list(best)
        for first, count, new in sorted(edits, reverse=True):
            ids[first : first + count] = new
        paths.add(tuple(ids))
    scores = dict((i, s) for s, i in want)
    assert sorted((scores[p] for p in paths), reverse=True) == e.scores[0]
    assert lattice.decode(e.ids).tobytes()[1:] == raw


@pytest.mark.parametrize("text", ["aaaaaaaaa", "abababab", "xyxyxyxyx", "\u65e5\u65e5\u65e5a\u65e5", "qzqzqzqzq"])
def test_tied_paths_are_exact(text):
    """Many equal scores: totals of the best paths are those of every path, and no path comes twice."""
    lattice = pieces.Lattice(pieces.Vocabulary.load())
    want = every_path(lattice, text.encode())
    for k in (1, 4, 9):
        got = lattice.nbest(text.encode(), k)
        assert [s for s, _ in got] == [s for s, _ in want[:k]]
        scores = dict((i, s) for s, i in want)
        assert len({i for _, i in got}) == len(got) and all(scores[i] == s for s, i in got)


def test_windows_of_a_long_chunk(monkeypatch):
    """A chunk read window by window has the path, score and gap of one read at once."""
    lattice = pieces.Lattice(pieces.Vocabulary.load())
    texts = ["".join(RNG.choice("etaoinshr\u65e5\u00e9qx0") for _ in range(n)) for n in (3, 40, 64, 65, 700, 2_000)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t.encode()) for t in texts])
    start = np.r_[0, end[:-1]]
    whole = lattice.segment(raw, start, end)
    monkeypatch.setattr(pieces, "WINDOW", 64)
    for a, b in zip(whole, lattice.segment(raw, start, end), strict=True):
        assert (a == b).all()


def test_text_without_spaces(spark):
    """A text of half a megabyte that is one chunk: encoded and decoded whole, with the totals of its best paths in order."""
    long = "".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500_000))
    got = pieces.digest(spark.createDataFrame([(1, long), (2, "a " + long[:1_000])], "doc_id long, text string")).collect()
    assert len(got) == 2 and all(r.round_trip and len(r.scores) == 4 and r.scores == sorted(r.scores, reverse=True) for r in got)


def test_encoding_round_trip(docs, rows):
    encoded = pieces.encode(docs)
    texts = sorted((str(r.doc_id), r.text) for r in pieces.decode(encoded).collect())
    assert texts == sorted((str(r[0]), r[1] or "") for r in rows)
    assert all(r.round_trip for r in pieces.digest(docs).collect())
    assert pieces.encode(docs.limit(0)).count() == 0
