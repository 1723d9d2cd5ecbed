"""Small per-class tables read as scalars instead of joined.

Labels are few but rows per label are many: a join on the label would hash a third of the
table into one task. A map with one entry per *declared* class, read through a scalar
subquery, adds no exchange of the rows and cannot outgrow the class list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_map(table: DataFrame, key: str, value: str | Column, classes: Sequence) -> DataFrame:
    """One row, one column: ``map(key -> value)`` restricted to ``classes``.

    A second row for one class stops the job instead of widening the map.
    """
    value = F.col(value) if isinstance(value, str) else value
    entries = table.where(F.col(key).isin(list(classes))).select(F.col(key).alias("_k"), value.alias("_v"))
    return entries.agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("entries"))


def with_lookup(df: DataFrame, table: DataFrame, key: str, value: str, classes: Sequence, out: str, on: str | None = None) -> DataFrame:
    """Add ``table[value]`` for the class in ``df[on]`` (null for a class without an entry)."""
    held = class_map(table, key, value, classes).scalar()
    return df.withColumn("_lookup", held).withColumn(out, F.try_element_at(F.col("_lookup"), F.col(on or key))).drop("_lookup")


def class_rows(classes: Sequence, name: str = "cluster_id") -> Column:
    """Generator with one row per class, used to fill absent classes with zero."""
    return F.explode(F.array(*[F.lit(c) for c in classes])).alias(name)
