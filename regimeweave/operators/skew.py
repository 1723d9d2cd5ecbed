"""Joins of a many-row side whose key may be held by a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 10_000


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row per key.

    The ``hot_keys`` most frequent keys of ``left`` are joined without moving ``left``: the
    broadcast side has at most ``hot_keys`` rows, whatever the size of the tables. Every other
    key has at most ``rows / hot_keys`` rows and takes the ordinary shuffle join. Null keys
    match nothing; they stay with the hot side, where they are not shuffled.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError("how must keep or filter the left side")
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where("_n > 1").orderBy(F.col("_n").desc(), key).limit(hot_keys).select(key)
    marks = F.broadcast(hot.select(F.col(key).alias("_hot")))
    hot_right = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    nulls = F.col(key).isNull()
    marked = left.join(marks, F.col(key) == F.col("_hot"), "left")
    stay = marked.where(F.col("_hot").isNotNull() | nulls).drop("_hot")
    move = marked.where(F.col("_hot").isNull() & ~nulls).drop("_hot")
    return stay.join(hot_right, key, how).unionByName(move.join(right, key, how))
