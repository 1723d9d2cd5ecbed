"""Hashed text features and labelled samples, computed in Arrow batches on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regimeweave.llm import common as C

FOLDS = 5


def held_out() -> F.col:
    """Rows whose crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y`` of labelled documents outside the held-out fold; one with contradicting or null labels is left out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y"))
    return known.where("y = _y").select("doc_id", F.col("y").cast("int").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int) -> DataFrame:
    """``doc_id, text, y`` of labelled rows outside the held-out fold: at most ``max_rows`` rows and ``max_bytes`` bytes of text, half for each label.

    Rows come in the order of a hash of their id and text, so the sample does not depend on
    partitions; the first row over the bytes ends it. A row is in it with its whole text or not at all, and one whose
    text alone exceeds half the bytes is not. Rows equal in id and text are one. A document with
    contradicting or null labels is left out. Ids and sizes are chosen first, so only chosen texts move.
    """
    half, room = max_rows // 2, max_bytes // 2
    text_key = F.xxhash64("text")
    sizes = docs.select("doc_id", text_key.alias("_text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("_size"))
    known = sizes.where(F.col("_size") <= room).join(agreed(labels, label), "doc_id").groupBy("doc_id", "_text", "y").agg(F.max("_size").alias("_size"))
    known = known.withColumn("_key", F.xxhash64("doc_id", "_text", F.lit("sample")))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("y") == value).orderBy("_key", "doc_id", "_text").limit(half)
        # a window over ``half`` narrow rows
        so_far = F.sum("_size").over(Window.orderBy("_key", "doc_id", "_text"))
        part = part.select("*", so_far.alias("_sum")).where(F.col("_sum") <= room)
        chosen = part if chosen is None else chosen.unionByName(part)
    names = ["doc_id", "_text"]
    return docs.select("doc_id", text_key.alias("_text"), "text").join(chosen.select(*names, "y"), names).dropDuplicates(names).select("doc_id", "text", "y")


def ngram_buckets(data: np.ndarray, bounds: np.ndarray, bits: int, orders: tuple[int, ...] = (1, 2)) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word n-grams of each row: row numbers and buckets, sorted by row.

    Words are taken twice: whole, and as their last three bytes, which carry endings and marks.
    A word that repeats the one before it is one more indicator, whatever the word.
    """
    start, end, counts = C.words(data, bounds)
    rows = np.repeat(np.arange(len(counts)), counts)
    prefix = C.prefix_hash(data)
    whole = C.span_hash(prefix, start, end)
    tail = C.span_hash(prefix, np.maximum(start, end - 3), end) ^ np.uint64(0x5851F42D4C957F2D)
    keys, owners = [whole, C.mix64(tail)], [rows, rows]
    for n in orders:
        if n > 1 and len(whole) >= n:
            same = rows[n - 1 :] == rows[: len(rows) - n + 1]
            gram = whole[: len(whole) - n + 1].copy()
            for j in range(1, n):
                gram = C.mix64(gram * np.uint64(3) + whole[j : len(whole) - n + 1 + j])
            if n == 2:
                again = same & (whole[1:] == whole[:-1])
                keys.append(np.full(int(again.sum()), 0xD6E8FEB86659FD93, np.uint64))
                owners.append(rows[:-1][again])
            keys.append(gram[same])
            owners.append(rows[: len(rows) - n + 1][same])
    bucket = np.concatenate(keys) >> np.uint64(64 - bits)
    packed = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(bits)) | bucket)
    return (packed >> np.uint64(bits)).astype(np.int64), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
