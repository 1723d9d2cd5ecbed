"""Row numbers and running totals over groups too long for one task.

A group (one symbol, one partition, one class) may hold a large share of all rows, so no
window here is partitioned by the group alone. Rows are cut into *blocks* by a coarse key that
rises with the sort order (a time block, an id block). Windows run inside ``(group, block)``;
a table with one row per block carries the totals across. Both sides share the hash
partitioning on ``(group, block)``, so the join back adds no further exchange of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def running(by: Sequence[str], *order, before: bool = False):
    """Frame from the group's first block up to this block (or up to the one before)."""
    window = Window.partitionBy(*by).orderBy(*order)
    return window.rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)


def with_position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    block: Column,
    out: str = "row_index",
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row inside its group.

    ``block`` must not fall when ``order`` rises; ``order`` must be unique inside a group.
    """
    keys = [*by, BLOCK]
    blocked = df.withColumn(BLOCK, block)
    sizes = blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *keys,
        F.coalesce(F.sum("_n").over(running(by, BLOCK, before=True)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("_total"),
    )
    local = blocked.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    numbered = local.join(offsets, keys).withColumn(out, F.col("_before") + F.col("_local") - 1)
    if total:
        numbered = numbered.withColumn(total, F.col("_total"))
    return numbered.drop(BLOCK, "_local", "_before", "_total")


def with_tied_position(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tiebreak: Sequence[str],
    block: Column,
    out: str = "row_index",
) -> DataFrame:
    """0-based position when many rows share the leading order column ``value``.

    Rows are counted per value first (copies merge before the shuffle), the counts are summed
    up in blocks of values, and only rows of one value are numbered together. ``block`` is a
    coarse key of ``value``; ``(value, tiebreak)`` must be unique inside a group.
    """
    keys = [*by, value]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    sums = with_running_sums(counts, by, [value], block, {"_to": F.col("_c")})
    offsets = sums.select(*keys, (F.col("_to") - F.col("_c")).alias("_from"))
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*tiebreak)))
    numbered = local.join(offsets, keys)
    return numbered.withColumn(out, F.col("_from") + F.col("_local") - 1).drop("_local", "_from")


def with_running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    block: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums along ``order``; ``sums`` maps an output name to the summed value."""
    keys = [*by, BLOCK]
    blocked = df.withColumn(BLOCK, block)
    blocks = blocked.groupBy(*keys).agg(*[F.sum(v).alias(f"_b_{name}") for name, v in sums.items()])
    before = running(by, BLOCK, before=True)
    offsets = blocks.select(
        *keys, *[F.coalesce(F.sum(f"_b_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums]
    )
    inside = running(keys, *order)
    local = blocked.withColumns({f"_l_{name}": F.sum(v).over(inside) for name, v in sums.items()})
    joined = local.join(offsets, keys)
    result = joined.withColumns({name: F.col(f"_l_{name}") + F.col(f"_o_{name}") for name in sums})
    return result.drop(BLOCK, *[f"_l_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def with_previous(
    df: DataFrame, by: Sequence[str], order: Sequence[str], block: Column, value: str, out: str
) -> DataFrame:
    """Value of the preceding row (null at the start); ``value`` itself must not be null."""
    keys = [*by, BLOCK]
    blocked = df.withColumn(BLOCK, block)
    position = F.struct(*order)
    lasts = blocked.groupBy(*keys).agg(F.max_by(value, position).alias("_last"))
    carried = lasts.select(
        *keys, F.lag("_last").over(Window.partitionBy(*by).orderBy(BLOCK)).alias("_carried")
    )
    local = blocked.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    return (
        local.join(carried, keys)
        .withColumn(out, F.coalesce(F.col(out), F.col("_carried")))
        .drop(BLOCK, "_carried")
    )


def is_monotonic(
    df: DataFrame, order: Sequence[str], block: Column, value: str, by: Sequence[str] = ()
) -> DataFrame:
    """Per group: does ``value`` never fall along ``order``."""
    before = with_previous(df.select(*by, *dict.fromkeys([*order, value])), by, order, block, value, "_previous")
    ok = F.coalesce(F.col("_previous") <= F.col(value), F.lit(True))
    return before.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.bool_and(ok).alias("monotonic"),
        F.count_if(~ok).alias("falls"),
    )


def contiguous_ranges(df: DataFrame, value: str, by: Sequence[str] = (), size: int = 1_000_000) -> DataFrame:
    """First, last and count of every maximal run of consecutive integers."""
    distinct = df.select(*by, F.col(value).cast("bigint").alias("_v")).where("_v is not null").distinct()
    placed = with_position(distinct, by, ["_v"], F.floor(F.col("_v") / size), "_p")
    return (
        placed.groupBy(*by, (F.col("_v") - F.col("_p")).alias("_island"))
        .agg(F.min("_v").alias("first"), F.max("_v").alias("last"), F.count(F.lit(1)).alias("count"))
        .drop("_island")
    )
