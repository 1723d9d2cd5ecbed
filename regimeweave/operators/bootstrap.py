"""Moving-block bootstrap of differences in macro-F1.

No resampled row is ever built. A running sum of one-hot confusion counts gives the counts of
any block as the difference of two of its rows, so a draw costs two lookups per block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimeweave.functions.timing import id_block
from regimeweave.operators.metrics import macro_f1
from regimeweave.operators.ordering import with_running_sums

BLOCK_SIZE = 1_000_000


def effective_blocks(rows: Column, length: int) -> Column:
    """Number of blocks of ``length`` rows that cover ``rows``."""
    return F.ceil(rows / F.lit(length)).cast("bigint")


def block_length(n_in: int, n_out: int, stride: int, least: int = 8) -> int:
    """Block length in rows: twice the span of one sample, at least ``least``."""
    return max(least, math.ceil(2 * (n_in + n_out) / stride))


def draw_starts(
    rows: DataFrame, length: int, draws: int, seed: int = 0, start_expr=None, chunk: int = 4096
) -> DataFrame:
    """``(draw, block, start)`` for every draw, for a table ``rows`` of unknown size.

    A start is uniform over the positions where a whole block fits, chosen by a seeded hash, or
    by ``start_expr(draw, block, n_starts)``. Blocks are generated in chunks, never as one long array.
    """
    spark = rows.sparkSession
    count = rows.agg(F.count(F.lit(1)))
    base = spark.range(draws).withColumnRenamed("id", "draw").withColumn("_n", count.scalar())
    base = base.withColumn("_blocks", effective_blocks(F.col("_n"), length)).where("_blocks > 0")
    chunks = base.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(_blocks - 1) div {chunk}"))).alias("_c"))
    first = F.col("_c") * chunk
    last = F.least(first + (chunk - 1), F.col("_blocks") - 1)
    blocks = chunks.select("draw", "_n", F.explode(F.sequence(first, last)).alias("block"))
    places = F.greatest(F.col("_n") - (length - 1), F.lit(1))
    if start_expr is None:
        start = F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), F.col("block")), places)
    else:
        start = start_expr(F.col("draw"), F.col("block"), places)
    return blocks.select("draw", "block", start.cast("bigint").alias("start"))


def numpy_starts(spark: SparkSession, n: int, length: int, draws: int, seed: int = 0) -> DataFrame:
    """The starts a NumPy generator would give, for comparison with published intervals.

    Driver-side and of size ``draws * ceil(n / length)``; meant for test sets of known, small size.
    """
    import numpy as np

    blocks = math.ceil(n / length)
    if draws * blocks > 5_000_000:
        raise ValueError("too many blocks for driver-side starts; use draw_starts")
    generator = np.random.default_rng(seed)
    places = np.arange(0, max(1, n - length + 1))
    rows = []
    for draw in range(draws):
        picked = generator.choice(places, size=blocks, replace=True)
        rows.extend((draw, j, int(s)) for j, s in enumerate(picked))
    return spark.createDataFrame(rows, "draw bigint, block bigint, start bigint")


def bootstrap_draws(
    rows: DataFrame,
    starts: DataFrame,
    length: int,
    k: int,
    models: Sequence[str],
    baseline: str,
    position: str = "position",
    actual: str = "actual",
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """Per draw: macro-F1 of every model, of the baseline, and mean model score minus baseline.

    ``rows`` holds ``position`` 0..n-1 in time order, the actual class and one predicted class
    per model. Blocks are laid one after another and cut at ``n`` rows.
    """
    names = [*models, baseline]
    pairs = [(a, p) for a in range(k) for p in range(k)]
    hot = {
        f"c_{m}_{a}_{p}": ((F.col(actual) == a) & (F.col(name) == p)).cast("bigint")
        for m, name in enumerate(names)
        for a, p in pairs
    }
    hot = {c: F.coalesce(v, F.lit(0).cast("bigint")) for c, v in hot.items()}
    slim = rows.select(F.col(position).cast("bigint").alias("_p"), actual, *dict.fromkeys(names))
    sums = with_running_sums(slim, [], ["_p"], id_block(F.col("_p"), block_size), hot)
    prefix = sums.select((F.col("_p") + 1).alias("at"), *hot)
    held = starts.withColumn("_n", rows.agg(F.count(F.lit(1))).scalar())
    size = F.least(F.lit(length), F.col("_n") - F.col("block") * length, F.col("_n") - F.col("start"))
    ends = held.select(
        "draw",
        F.inline(
            F.array(
                F.struct((F.col("start") + size).alias("at"), F.lit(1).alias("sign")),
                F.struct(F.col("start").alias("at"), F.lit(-1).alias("sign")),
            )
        ),
    )
    # position 0 has an empty running sum; the inner join leaves it out
    joined = ends.join(prefix, "at")
    drawn = joined.groupBy("draw").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in hot])
    scores = [
        macro_f1(F.array(*[F.col(f"c_{m}_{a}_{p}") for a, p in pairs]), k).alias(f"f1_{name}")
        for m, name in enumerate(names)
    ]
    scored = drawn.select("draw", *scores)
    mean = F.col(f"f1_{models[0]}")
    for name in models[1:]:
        mean = mean + F.col(f"f1_{name}")
    return scored.withColumn("difference", mean / len(models) - F.col(f"f1_{baseline}"))


def bootstrap_scores(
    rows: DataFrame,
    starts: DataFrame,
    length: int,
    k: int,
    by: Sequence[str],
    position: str = "position",
    actual: str = "actual",
    predicted: str = "predicted",
    block_size: int = BLOCK_SIZE,
) -> DataFrame:
    """``draw, *by, macro_f1`` for any number of models: one row per model and position, not one column per model.

    ``rows`` holds the positions 0..n-1 of every model named by ``by``. All models share the draws of ``starts``, so their
    scores can be compared draw by draw.
    """
    cells = {f"c_{a}_{p}": F.coalesce(((F.col(actual) == a) & (F.col(predicted) == p)).cast("bigint"), F.lit(0).cast("bigint")) for a in range(k) for p in range(k)}
    slim = rows.select(*by, F.col(position).cast("bigint").alias("_p"), actual, predicted)
    sums = with_running_sums(slim, list(by), ["_p"], id_block(F.col("_p"), block_size), cells)
    prefix = sums.select(*by, (F.col("_p") + 1).alias("at"), *cells)
    n = rows.agg((F.max(position) + 1).cast("bigint"))
    held = starts.withColumn("_n", n.scalar())
    size = F.least(F.lit(length), F.col("_n") - F.col("block") * length, F.col("_n") - F.col("start"))
    edges = F.array(F.struct((F.col("start") + size).alias("at"), F.lit(1).alias("sign")), F.struct(F.col("start").alias("at"), F.lit(-1).alias("sign")))
    # many draws share an edge: its sign is added up before it meets the models
    ends = held.select("draw", F.inline(edges)).where("at > 0").groupBy("draw", "at").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    drawn = ends.join(prefix, "at").groupBy("draw", *by).agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in cells])
    return drawn.select("draw", *by, macro_f1(F.array(*cells), k).alias("macro_f1"))


def interval(draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval and share of positive differences; one row per draw was made above."""
    return draws.agg(
        F.count(F.lit(1)).alias("draws"),
        F.avg("difference").alias("mean_difference"),
        F.percentile("difference", F.lit(low)).alias("ci_low"),
        F.percentile("difference", F.lit(high)).alias("ci_high"),
        F.avg((F.col("difference") > 0).cast("double")).alias("p_gt_0"),
    )


def block_bootstrap(
    rows: DataFrame,
    k: int,
    models: Sequence[str],
    baseline: str,
    length: int = 120,
    draws: int = 2000,
    seed: int = 0,
    starts: DataFrame | None = None,
    position: str = "position",
    actual: str = "actual",
) -> DataFrame:
    """Interval of (mean) model macro-F1 minus baseline macro-F1."""
    starts = draw_starts(rows, length, draws, seed) if starts is None else starts
    return interval(bootstrap_draws(rows, starts, length, k, models, baseline, position, actual))
