"""One query per operator on its whole table, and their check statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regimeweave.llm import (
    exact_dedup,
    fair_mix,
    ngram_join,
    phrases,
    pieces,
    quality_model,
    quality_rules,
    quote_links,
    repeats,
    token_cache,
    toxicity,
    url_filter,
    word_runs,
)
from regimeweave.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op2_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op3_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.link_quotes(table(spark, sf_dir, "conversations"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.evaluate(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.refine(table(spark, sf_dir, "documents"), digest_singles=True)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.queue(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.report(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_piece_encoding": op2_piece_encoding,
    "op3_chat_quotes": op3_chat_quotes,
    "op4_ngram_join": op4_ngram_join,
    "op5_repeated_bytes": op5_repeated_bytes,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_model": op8_quality_model,
    "op9_toxicity": op9_toxicity,
    "op10_fair_mix": op10_fair_mix,
    "op11_token_counts": op11_token_counts,
    "op12_phrases": op12_phrases,
    "op13_word_runs": op13_word_runs,
}
SQL = {
    "op3_chat_quotes": quote_links.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op10_fair_mix": fair_mix.SQL,
    "op12_phrases": phrases.SQL,
}
