"""Exact linear-interpolation quantiles for groups of any size.

``percentile`` keeps every distinct value of a group in one buffer, and a window over a group sorts
it in one task. Here the wanted ranks are selected by counting: values fall into at most
``2 * BLOCKS`` ordered blocks, a running sum over the block counts finds the block that holds a rank, and
that block is divided again. The first level divides by magnitude, each further one divides what
its block really spans into equal widths, so after four levels every block is a single value:
a sixteenth of an octave holds fewer than 2^48 doubles, and each level divides them by 2^16.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimeweave.operators.lookups import class_map

BLOCKS = 1 << 16
LEVELS = 4


def exact_quantile(
    df: DataFrame,
    value: str | Column,
    p: float,
    by: str | None = None,
    classes: Sequence | None = None,
    out: str = "quantile",
) -> DataFrame:
    """The ``p`` quantile (0..1) of ``value``: one row, or one row per entry of ``classes`` present in ``by``.

    Null values are ignored; NaN is above all numbers. ``classes`` fixes the group labels, which bounds
    everything that is kept per group; rows with another label belong to no group.

    Equal values of a group are counted before they move, and the four levels read the one shuffle of
    these counts. A level sorts block counts, never values; no table size changes the path taken.
    """
    value = F.col(value) if isinstance(value, str) else value
    key = F.col(by) if by else F.lit(0)
    rows = df.select(key.alias("_g"), value.cast("double").alias("_x")).where("_x is not null")
    groups = list(classes) if by else [0]
    if by:
        rows = rows.where(F.col("_g").isin(groups))
    counts = rows.groupBy("_g", "_x").agg(F.count(F.lit(1)).alias("_c"))
    picked = _first_level(counts, p)
    for _ in range(LEVELS - 1):
        # one entry per class, read as a scalar: no join of the rows on a skewed class label
        held = class_map(picked, "_g", F.struct("n", "a", "z"), groups)
        picked = _next_level(counts.withColumn("_held", held.scalar()))
    share = F.lit(float(p)) * (F.col("n") - 1)
    low, high = F.col("a.low"), F.col("z.low")
    # an infinite neighbour that has no share in the result leaves it alone
    exact = picked.select("_g", F.when(share == F.floor(share), low).otherwise(low + (high - low) * (share - F.floor(share))).alias(out))
    return exact.withColumnRenamed("_g", by) if by else exact.select(out)


def _magnitude(x: Column) -> Column:
    """Block number that never falls as ``x`` rises: sixteenths of an octave, mirrored below zero."""
    step = F.floor(F.log2(F.abs(x)) * 16) + 18_000
    finite = F.when(x > 0, step).when(x < 0, -step).otherwise(0)
    edge = F.lit(40_000)
    return F.when(F.isnan(x), edge + 1).when(x == float("inf"), edge).when(x == float("-inf"), -edge).otherwise(finite)


def _first_level(counts: DataFrame, p: float) -> DataFrame:
    """``_g, n`` and for both wanted ranks the block that holds it: ``(low, high, rank)``, the rank counted inside the block."""
    blocks = counts.groupBy("_g", _magnitude(F.col("_x")).alias("_block")).agg(
        F.sum("_c").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high")
    )
    whole = Window.partitionBy("_g")
    upto = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.withColumns({"_to": F.sum("_c").over(upto), "n": F.sum("_c").over(whole)})
    lower = F.floor(F.lit(float(p)) * (F.col("n") - 1))
    upper = F.least(lower + 1, F.col("n") - 1)
    return summed.groupBy("_g", "n").agg(_holding("_to", lower).alias("a"), _holding("_to", upper).alias("z"))


def _holding(to: str, rank: Column) -> Column:
    start = F.col(to) - F.col("_c")
    entry = F.struct(F.col("_low").alias("low"), F.col("_high").alias("high"), (rank - start).cast("bigint").alias("rank"))
    return F.max(F.when((start <= rank) & (rank < F.col(to)), entry))


def _next_level(counts: DataFrame) -> DataFrame:
    """The blocks of both ranks divided into ``BLOCKS`` parts; the two are one block or disjoint."""
    held = counts.withColumn("_k", F.try_element_at("_held", F.col("_g")))

    def part(which: str) -> Column:
        low, high = F.col(f"_k.{which}.low"), F.col(f"_k.{which}.high")
        # no block spans zero or more than a part of an octave, so both differences are exact
        share = F.try_divide(F.col("_x") - low, high - low)
        inside = F.col("_x").between(low, high)
        return F.when(inside, F.when(low == high, 0).otherwise(F.floor(share * (BLOCKS - 1))))

    blocks = held.groupBy("_g", F.col("_k.n").alias("n"), part("a").alias("_a"), part("z").alias("_z")).agg(
        F.sum("_c").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"),
        F.first("_k.a.rank").alias("_a_rank"), F.first("_k.z.rank").alias("_z_rank"),
    )
    # everything outside both blocks is one row of nulls here; a filter instead would be pushed below the shared counts
    upto = Window.partitionBy("_g").orderBy(F.coalesce("_a", F.col("_z") + BLOCKS)).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.withColumns(
        {f"_{w}_to": F.sum(F.when(F.col(f"_{w}").isNotNull(), F.col("_c"))).over(upto) for w in ("a", "z")}
    )
    wanted = {w: F.when(F.col(f"_{w}").isNotNull(), F.col(f"_{w}_rank")) for w in ("a", "z")}
    return summed.groupBy("_g", "n").agg(*[_holding(f"_{w}_to", wanted[w]).alias(w) for w in ("a", "z")])
