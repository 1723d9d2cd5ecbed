"""Collocations against brute force, for small limits and odd rows; the statement runs in test_native."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regimeweave.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n string, phrase string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, longest, covered, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    gone = set()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= covered * f[lang, w[i : i + m]]:
                    gone.add((lang, w[i : i + m]))
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, rank + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["a", "B", "é", "the", "of", "x y", "日本", "z'", "\x85"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\x0b", "?!"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), "x", "y"))
    rows += [rows[7], rows[7], (None, "a b the of", "und", None, None), (4, None, "en", None, None), (5, "", "empty", None, None), (6, " . ", "", None, None), (8, "A", "", "q", "q")]
    return rows + [(9, "very long " * 30_000, "la", "q", "q"), (10, "w" * 200_000, "la", "q", "q"), (11, "Aa aA " * 50, "up", "q", "q")]


@pytest.mark.parametrize(("min_count", "longest", "covered", "top"), [(30, 4, 80, 2000), (2, 4, 80, 50), (3, 3, 50, 7), (12, 4, 100, 2000)])
def test_equals_brute_force(spark, rows, min_count, longest, covered, top):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = phrases.collocations(docs, min_count, longest, covered, top, bits=14).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, min_count, longest, covered, top)


def test_a_full_table_loses_nothing(spark, rows):
    """Buckets that all words share only let more windows through."""
    docs = spark.createDataFrame(rows, SCHEMA)
    few, many = (sorted(map(tuple, phrases.collocations(docs, bits=b).collect())) for b in (4, 20))
    assert few == many == brute(rows, 30, 4, 80, 2000)


@pytest.mark.parametrize(("blocks", "held"), [(1, 1), (3, 40), (50, 1 << 20)])
def test_packed_windows_hold_every_word(spark, rows, blocks, held):
    """However often a task packs and whatever the blocks: sums of a block are exact, a pair is in one block only."""
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    packed = phrases.windows(docs, phrases.frequent_buckets(docs, 2, 3, 14), blocks, held)
    found, total, seen = Counter(), Counter(), {}
    for (lang, block), part in packed.toPandas().groupby(["lang", "block"]):
        merged = phrases.merged_windows(pa.Table.from_pandas(part, preserve_index=False), 3, 2).to_pylist()
        assert len({(r["w1"], r["w2"], r["w3"]) for r in merged}) == len(merged)
        for r in merged:
            w = [x for x in (r["w1"], r["w2"], r["w3"]) if x]
            assert len(w) < 2 or seen.setdefault((lang, *w[:2]), block) == block
            found.update({(lang, *w[:k]): r["n"] for k in range(len(w) + 1)})
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[(lang,)] += len(w)
            total.update((lang, *w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
    assert {k: v for k, v in found.items() if len(k) != 2} == {k: v for k, v in total.items() if v >= 2 or len(k) == 1 and v}


def test_the_shuffle_is_bounded_by_the_words(spark):
    """With every window let through, a task sends a few bytes for each, and one row for each language and block."""
    rng = np.random.default_rng(5)
    words = [" ".join(f"word{i}" for i in rng.zipf(1.3, 200) % 3000) for _ in range(500)]
    docs = spark.createDataFrame([(t, "en") for t in words], "text string, lang string").coalesce(1)
    packed = phrases.windows(docs, phrases.frequent_buckets(docs, 2, 4, 4), 2).collect()
    assert len(packed) == 2 and sum(len(r.words) + len(r.codes) for r in packed) < 10 * 100_000


def test_buckets_hold_at_least_the_counts(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    tables = phrases.frequent_buckets(docs, 30, 4, 12)
    bits = [int(np.unpackbits(np.frombuffer(t, np.uint8)).sum()) for t in tables]
    assert len(bits) == 3 and 0 < bits[2] and max(bits) < 4096
    exact = phrases.phrase_counts(docs, 30, 4, 12).where("size > 0").groupBy("size").count().collect()
    assert all(bits[max(0, r["size"] - 2)] > 0 for r in exact) and len(exact) == 4
    with pytest.raises(ValueError):
        phrases.frequent_buckets(docs, 300)


def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_products_beyond_64_bits(spark):
    big = 2**62
    got = spark.range(1).select(F.lit(big).alias("a"), F.lit(big).alias("b")).select((phrases._wide("a") * F.lit(phrases.SCALE).cast("decimal(10,0)")).alias("x"), (phrases._wide("b") + phrases._wide("b")).alias("y")).selectExpr("x div y")
    assert got.collect()[0][0] == 1_000_000
