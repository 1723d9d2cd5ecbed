"""Periodic runs of words against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from regimeweave.llm import word_runs

SCHEMA = "doc_id long, text string, start string"


def brute_runs(w, min_length=6, min_exponent=4):
    n, seen = len(w), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_exponent * q):
                seen.setdefault((i, length), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in seen.items())


def collapsed(w, runs):
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(doc_id, text):
    w = words(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest(), n,
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.integers(2, 8), st.integers(2, 4))
def test_runs_of_symbols(rows, min_length, min_exponent):
    symbols, opens = [], []
    for k, row in enumerate(rows):
        opens.append(len(symbols))
        symbols += [100 * k + x for x in row] + [100 * k + 50]
    got = list(zip(*[x.tolist() for x in word_runs.runs_of(np.array(symbols, np.uint64), min_length, min_exponent)], strict=True))
    want = [(o + s, o + s + length, q) for o, row in zip(opens, rows, strict=True) for s, length, q in brute_runs(row, min_length, min_exponent)]
    assert sorted(got) == sorted(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(row):
    symbols = np.array([*row, 9], np.uint64)
    sa = word_runs.suffix_array(symbols)
    full = [*row, 9]
    assert sa.order.tolist() == sorted(range(len(full)), key=lambda i: full[i:])
    for p in range(1, len(full)):
        a, b = full[sa.order[p - 1] :], full[sa.order[p] :]
        assert sa.lcp[p] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    rows = []
    for i in range(400):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        w = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(w))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w[:at] + unit * rng.randint(0, 9) + w[at:]), "x"))
    rows += [(5, rows[5][1], "x"), (5, "a " * 9, "x"), (None, "b c " * 8, "y"), (401, None, "y"), (402, "", "y"), (403, " \n ", "y")]
    rows += [(404, "é ü " * 30, "z"), (405, "long " * 300 + " ".join("ab"[i.bit_count() % 2] for i in range(600)), "z"), (406, "a\x0bb\x85c d " * 6, "z")]
    rows += [(407, " ".join(rng.choice(["x y z z", "x y", "z"]) for _ in range(500)), "z"), (408, "x" * 100_000, "z")]
    return rows


def test_digest_equals_brute_force(spark, rows):
    got = word_runs.digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(i, t)) for i, t, _ in rows)
    assert any(r.n_runs > 1 for r in got)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = docs.select("doc_id", "text").collect()
    got = word_runs.digest(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(r.doc_id, r.text)) for r in some)


def test_operator_returns_runs_and_texts(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for r, (_, text, _) in zip(word_runs.find_runs(docs.coalesce(1), 4, 2).collect(), rows, strict=True):
        runs = brute_runs(words(text), 4, 2)
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == collapsed(words(text), runs)
    assert word_runs.find_runs(docs.limit(0)).count() == 0 and word_runs.digest(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        word_runs.find_runs(docs, min_exponent=1)
