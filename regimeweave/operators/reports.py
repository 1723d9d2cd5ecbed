"""Distribution, transition, duplicate and summary reports, and manifest ranks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimeweave.functions.timing import time_block
from regimeweave.operators.ordering import with_position, with_tied_position
from regimeweave.operators.skew import skew_join
from regimeweave.operators.soft_targets import class_counts


def with_rank(
    pairs: DataFrame,
    time: str = "input_start_time",
    partition: str = "partition",
    tiebreak: Sequence[str] = ("pair_id",),
    block: timedelta = timedelta(days=30),
    out: str = "chronological_rank",
) -> DataFrame:
    """0-based time order inside each partition; many symbols may share a start time."""
    return with_tied_position(pairs, [partition], time, tiebreak, time_block(F.col(time), block), out)


def with_shuffle_rank(
    df: DataFrame,
    seed: int,
    partition: str = "partition",
    key: str = "pair_id",
    rank_expr: Column | None = None,
    out: str = "shuffled_rank",
    buckets: int = 65_536,
) -> DataFrame:
    """A repeatable random order inside each partition; the rows themselves stay as they are.

    The order key is a seeded hash, so its high bits cut every partition into equal blocks.
    A ``rank_expr`` given instead must be a non-negative bigint below 2**31.
    """
    if rank_expr is None:
        order = F.xxhash64(F.col(key), F.lit(seed))
        shift = 64 - (buckets.bit_length() - 1)
        block = F.shiftright(F.col("_order"), shift)
    else:
        order = rank_expr.cast("bigint")
        block = F.shiftright(F.col("_order"), 31 - (buckets.bit_length() - 1))
    return with_position(df.withColumn("_order", order), [partition], ["_order", key], block, out).drop("_order")


def distribution(df: DataFrame, classes: Sequence[int], label: str = "target_cluster_id", by: Sequence[str] = ("partition",)) -> DataFrame:
    """Count and percent per partition and class, absent classes included."""
    counts = class_counts(df, label, classes, by)
    share = 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn("percentage", share)


def transition_counts(
    df: DataFrame,
    classes: Sequence[int],
    current: str = "input_cluster_id",
    future: str = "target_cluster_id",
    by: Sequence[str] = ("partition",),
) -> DataFrame:
    """Partition x current x future counts, zero-filled, in one aggregation."""
    cells = [
        F.struct(
            F.lit(a).alias("current_cluster_id"),
            F.lit(b).alias("future_cluster_id"),
            F.count_if((F.col(current) == a) & (F.col(future) == b)).alias("count"),
        )
        for a in classes
        for b in classes
    ]
    return df.groupBy(*by).agg(F.array(*cells).alias("_c")).select(*by, F.inline("_c"))


def content_hash(*columns: str | Column) -> Column:
    """SHA-256 of the columns' JSON text."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def duplicate_groups(df: DataFrame, digest: str, name: str) -> DataFrame:
    """Contents held by more than one row: how many, and the first name. Copies merge before the shuffle."""
    return (
        df.groupBy(digest)
        .agg(F.count(F.lit(1)).alias("members"), F.min(name).alias("first_name"))
        .where("members > 1")
    )


def duplicate_members(df: DataFrame, digest: str, name: str) -> DataFrame:
    """The rows of all duplicate groups, one row per member so that no group is held in one array."""
    groups = duplicate_groups(df, digest, name).select(digest)
    return skew_join(df.select(digest, name), groups, digest, "left_semi")


def duplicate_summary(df: DataFrame, digest: str, name: str) -> DataFrame:
    """Rows, distinct contents and duplicate groups, one row."""
    groups = df.groupBy(digest).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("unique_hash_count"),
        F.count_if(F.col("_n") > 1).alias("duplicate_group_count"),
    )


def run_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """One nested record from small reports: one-row reports as objects, longer ones as arrays.

    Every part must be a report, bounded by partitions, classes, sources or rules.
    """
    spark = next(iter(parts.values())).sparkSession
    record = spark.range(1).select()
    for name, part in parts.items():
        packed = part.agg(F.sort_array(F.collect_list(F.struct(*part.columns))))
        record = record.withColumn(name, packed.scalar())
    return record.select(F.to_json(F.struct(*parts)).alias("record"))
