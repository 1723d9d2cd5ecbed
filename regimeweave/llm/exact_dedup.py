"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeweave.llm.common import SPACE, stage, text_of

PREFIX_CHARS = 256


def refine(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, digest_singles: bool = False, carry: bool = False) -> DataFrame:
    """Marks every row with the row that stays of its group of equal texts.

    Texts are equal when identical after each run of white space became one space; null is the
    empty text. Adds ``keep_id`` (smallest doc_id of the group; null only if all are null),
    ``group_size``, ``kept`` and ``text_sha256``. Exactly one row of a group is kept, also among
    rows that repeat a doc_id. Other columns are only returned with ``carry``, as one struct
    ``doc``, so names of ``docs`` may clash with the added ones.

    Lengths and prefix hashes are counted as partial aggregates. The full hash is computed only
    for rows whose (length, prefix hash) occurs twice; ``digest_singles`` fills it in for the
    others too. No group is gathered: a group is one row (smallest id, count), joined back to
    the surviving rows, where adaptive execution splits a hot key. Other rows do not move again.
    With ``carry`` a text moves once, inside ``doc``, and is normalised anew where its hash is due.
    """
    spaced = lambda text: F.regexp_replace(text, SPACE, " ")
    width = F.octet_length("_norm")
    prefix = F.xxhash64(F.substring("_norm", 1, prefix_chars))
    own = ["doc_id", "doc"] if carry else ["doc_id"]
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    normal = docs.select("doc_id", *whole, spaced(text_of()).alias("_norm"))

    # rounds 1 and 2 on narrow rows
    narrow = normal.select(width.alias("_len"), prefix.alias("_prefix")).groupBy("_len", "_prefix").agg(F.count("*").alias("_n"))
    narrow = stage(narrow)
    lengths = narrow.groupBy("_len").agg(F.sum("_n").alias("_rows")).where("_rows > 1").select("_len")
    open_groups = narrow.where("_n > 1").join(lengths, "_len", "left_semi").select("_len", "_prefix", F.lit(True).alias("_open"))

    # round 3: the content of the surviving rows
    keyed = normal.withColumns({"_len": width, "_prefix": prefix, "_row": F.monotonically_increasing_id()})
    joined = keyed.join(open_groups, ["_len", "_prefix"], "left").withColumn("_open", F.coalesce("_open", F.lit(False)))
    full = F.sha2(spaced(text_of("doc.text")) if carry else F.col("_norm"), 256)
    marked = stage(
        joined.select(*own, "_row", "_open", (full if digest_singles else F.when(F.col("_open"), full)).alias("text_sha256"))
    )
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_row").alias("c"))
    groups = (
        marked.where("_open")
        .groupBy("text_sha256")
        .agg(F.min(order).alias("_first"), F.count("*").alias("_size"))
        .where("_size > 1")
        .select("text_sha256", F.col("_first.b").alias("_keep"), F.col("_first.c").alias("_keep_row"), "_size")
    )
    single = F.col("_size").isNull()
    met = marked.where("_open").join(groups, "text_sha256", "left").select(
        *own,
        F.when(single, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        (single | (F.col("_row") == F.col("_keep_row"))).alias("kept"),
        "text_sha256",
    )
    alone = marked.where(~F.col("_open")).select(
        *own, F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return met.unionByName(alone)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat an earlier text."""
    return refine(docs, carry=True).where("kept").select("doc.*")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""
