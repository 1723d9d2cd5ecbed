"""From raw documents to token ids: clean, drop copies and near copies, mix the sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimeweave.llm import exact_dedup, fair_mix, ngram_join, pieces, quality_rules
from regimeweave.llm.common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, then documents that fail. Null and empty texts fail; a null id or source is kept."""
    return quality_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, also among rows that repeat an id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest id, null last. Texts without a word stay."""
    return ngram_join.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the source mix takes, once per copy. A null source is a source."""
    return fair_mix.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_ids, ids, score`` of every row."""
    encoded = pieces.encode(docs)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", F.get("scores", F.lit(0)).alias("score"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("source mix", mix),
    ("piece encoding", encode),
]

# Near copies and segmentation are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
