"""Token counts equal the library's, misses are encoded once, stored counts are used."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regimeweave.llm import queries, token_cache

SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_cache.tokenizer_path())
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = ["a b", "a b", "it's <|endoftext|> we'll", "<|endoftext|>" * 3, "", None, " ", "\n\n a \n  b\t\tc ", "é" * 300, "日本語。テキスト、" * 50]
    texts += [" ".join(rng.choice(["alpha", "beta!", "don't", "12,5", "\n", "  ", "x" * 40]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += ["z" * 50_000, "word " * 60_000, "one.two." * 20_000]
    return [(i, t, "own") for i, t in enumerate(texts)] + [(0, "a b", "again"), (0, "other", "again"), (None, "a b", ""), (None, "null id", ""), (None, "null id", "")]


def test_counts_equal_the_library(spark, rows, library, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = token_cache.count_tokens(docs, str(tmp_path / "cache"), hot_keys=2).collect()
    want = [(i, len((t or "").encode()), library(t)) for i, t, _ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_cache.count_tokens(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_only_misses_are_encoded(spark, rows, tmp_path):
    docs, cache = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "cache")
    counter = token_cache.Counter(token_cache.tokenizer_path())
    stored = lambda: spark.read.parquet(f"{cache}/version={counter.version}")
    token_cache.count_tokens(docs.where("doc_id < 40"), cache).count()
    first = stored().select("digest").distinct().count()
    distinct = lambda d: d.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert first == distinct(docs.where("doc_id < 40")) >= stored().count() - 1  # one row repeats id and text
    token_cache.count_tokens(docs, cache).count()
    assert stored().select("digest").distinct().count() == distinct(docs) > first
    again = stored().count()
    token_cache.count_tokens(docs, cache).count()
    assert stored().count() == again
    # stored counts answer, also doubled ones of two runs at a time
    spark.createDataFrame([("never seen",)], "text string").select(token_cache.digest_of("text").alias("digest"), F.lit(77).cast("long").alias("n_tokens")).union(
        stored()
    ).write.mode("append").parquet(f"{cache}/version={counter.version}")
    new = spark.createDataFrame([(1, "never seen", ""), (2, "a b", "")], SCHEMA)
    assert sorted(tuple(r) for r in token_cache.count_tokens(new, cache).collect()) == [(1, 10, 77), (2, 3, 2)]


def test_other_files_have_their_own_store(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    docs, cache = spark.createDataFrame([(1, "Some words here", ""), (2, "", "")], SCHEMA), str(tmp_path / "cache")
    token_cache.count_tokens(docs, cache).count()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_cache.count_tokens(docs, cache, path).collect()}
    assert got == {1: len(model.encode("Some words here")), 2: 0}
    words = token_cache.Counter(str(public_tokenizers.path("word_bpe_49k.json")))
    assert not words.cuts and words.windows("a b " * 100_000) == ["a b " * 100_000]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab,.;'s \n\t\u00a0\u3000é日、。!12<|>endoftx\x85", "<|endoftext|>", "'ll"]), max_size=60).map("".join))
def test_windows_keep_the_count(text):
    counter = test_windows_keep_the_count.__dict__.setdefault("counter", token_cache.Counter(token_cache.tokenizer_path()))
    parts = counter.windows(text, 3)
    assert "".join(parts) == text and sum(counter.count(parts)) == counter.count([text])[0] == sum(counter.sums(parts))


def test_given_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: (len(r.text.encode()), library(r.text), library(r.text) > 1024) for r in docs}
