"""Rolling windows over gap-free runs: manifests, skip tables, arrays and numeric features."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regimeweave.functions.predicates import PRICES
from regimeweave.functions.timing import interval, time_block
from regimeweave.functions.vectors import TINY, let
from regimeweave.operators.gaps import BLOCK_WIDTH, HOUR
from regimeweave.operators.ordering import BLOCK


def stride_filter(df: DataFrame, stride: int, column: str = "start_index") -> DataFrame:
    """Keep every ``stride``-th start."""
    return df.where(F.pmod(F.col(column), F.lit(stride)) == 0)


def is_start(n: int) -> Column:
    """A gap-free window of ``n`` candles begins at this row of a run table."""
    return F.col("run_end_index") - F.col("row_index") >= n - 1


def is_candidate(n: int) -> Column:
    """``n`` rows exist from this row on, gap or not."""
    return F.col("row_index") <= F.col("max_index") - (n - 1)


def valid_starts(runs: DataFrame, n: int, stride: int = 1, by: Sequence[str] = ("symbol",), time: str = "open_time") -> DataFrame:
    """Rows where a gap-free window of ``n`` candles begins."""
    return stride_filter(runs.where(is_start(n)), stride, "row_index").select(
        *by, F.col("row_index").alias("start_index"), F.col(time).alias("start_time")
    )


def sample_name(start: Column, stop: Column) -> Column:
    return F.concat_ws("_", F.lit("sample"), start.cast("string"), stop.cast("string"))


def build_windows(
    runs: DataFrame,
    n: int,
    every: timedelta = HOUR,
    stride: int = 1,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
) -> DataFrame:
    """Manifest of gap-free windows. Inside a run the end time follows from the length."""
    start, stop = F.col("row_index"), F.col("row_index") + (n - 1)
    return stride_filter(runs.where(is_start(n)), stride, "row_index").select(
        *by,
        sample_name(start, stop).alias("sample_name"),
        start.alias("start_index"),
        stop.alias("stop_index"),
        F.lit(n).cast("bigint").alias("window_length"),
        F.col(time).alias("start_time"),
        (F.col(time) + interval(every, n - 1)).alias("stop_time"),
    )


def skipped_windows(
    runs: DataFrame,
    n: int,
    stride: int = 1,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
) -> DataFrame:
    """Candidates that hold a gap, with the first gap met and the time of the last row."""
    bad = stride_filter(runs.where(is_candidate(n) & ~is_start(n)), stride, "row_index")
    start, stop = F.col("row_index"), F.col("row_index") + (n - 1)
    bad = bad.select(
        *by,
        sample_name(start, stop).alias("sample_name"),
        start.alias("start_index"),
        stop.alias("stop_index"),
        F.col(time).alias("start_time"),
        F.lit(f"timestamp_gap_inside_{n}_candle_window").alias("reason"),
        F.col("run_end_time").alias("gap_after_time"),
        F.col("run_end_next").alias("next_time"),
    )
    ends = runs.select(*by, F.col("row_index").alias("stop_index"), F.col(time).alias("stop_time"))
    return bad.join(ends, [*by, "stop_index"])


def candidate_spans(
    runs: DataFrame,
    n_in: int,
    n_out: int,
    every: timedelta = HOUR,
    stride: int = 1,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
) -> DataFrame:
    """Every start as one input-plus-target span, with the reason when it cannot be used."""
    n = n_in + n_out
    at = F.col("row_index")
    reason = F.when(~is_candidate(n), F.lit(f"incomplete_{n}_candle_span")).when(
        ~is_start(n), F.lit("timestamp_gap_within_input_or_target")
    )
    return stride_filter(runs, stride, "row_index").select(
        *by,
        sample_name(at, at + (n_in - 1)).alias("sample_name"),
        sample_name(at + n_in, at + (n - 1)).alias("target_sample_name"),
        at.alias("input_start_index"),
        (at + (n_in - 1)).alias("input_stop_index"),
        (at + n_in).alias("target_start_index"),
        (at + (n - 1)).alias("target_stop_index"),
        F.col(time).alias("input_start_time"),
        (F.col(time) + interval(every, n_in - 1)).alias("input_stop_time"),
        (F.col(time) + interval(every, n_in)).alias("target_start_time"),
        (F.col(time) + interval(every, n - 1)).alias("target_stop_time"),
        reason.alias("reason"),
    )


def build_spans(
    runs: DataFrame, n_in: int, n_out: int, every: timedelta = HOUR, stride: int = 1, by: Sequence[str] = ("symbol",), time: str = "open_time"
) -> DataFrame:
    """Usable spans only: one continuity test over input and target together."""
    return candidate_spans(runs, n_in, n_out, every, stride, by, time).where("reason is null").drop("reason")


def skipped_spans(
    runs: DataFrame,
    n_in: int,
    n_out: int,
    every: timedelta = HOUR,
    stride: int = 1,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    with_tail: bool = False,
) -> DataFrame:
    """Unusable spans and why; starts too close to the end are listed only with ``with_tail``."""
    spans = candidate_spans(runs, n_in, n_out, every, stride, by, time).where("reason is not null")
    if not with_tail:
        spans = spans.where(F.col("reason") != f"incomplete_{n_in + n_out}_candle_span")
    return spans.select(*by, "input_start_index", "input_start_time", "reason")


def _with_halo(
    runs: DataFrame, n: int, every: timedelta, by: Sequence[str], time: str, block: timedelta
) -> DataFrame:
    """Each time block plus the ``n - 1`` steps after it, so a window never leaves its block.

    A gap-free window spans exactly ``(n - 1) * every``, hence the copied margin is complete.
    """
    if every * (n - 1) > block:
        raise ValueError("a window must not be longer than a block")
    own = time_block(F.col(time), block)
    marked = runs.withColumn("_own_block", own)
    early = F.col(time) < F.col("_own_block") + interval(every, n - 1)
    before = F.col("_own_block") - interval(block)
    blocks = F.when(early, F.array(F.col("_own_block"), before)).otherwise(F.array(F.col("_own_block")))
    return marked.withColumn(BLOCK, F.explode(blocks))


def window_arrays(
    runs: DataFrame,
    n: int,
    every: timedelta = HOUR,
    stride: int = 1,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    block: timedelta = BLOCK_WIDTH,
) -> DataFrame:
    """The ``n`` candles of every valid window as four arrays, oldest first."""
    frame = Window.partitionBy(*by, BLOCK).orderBy(time).rowsBetween(0, n - 1)
    halo = _with_halo(runs, n, every, by, time, block)
    gathered = halo.withColumn("_candles", F.collect_list(F.struct(*PRICES)).over(frame))
    kept = stride_filter(gathered.where((F.col(BLOCK) == F.col("_own_block")) & is_start(n)), stride, "row_index")
    return kept.select(
        *by,
        F.col("row_index").alias("start_index"),
        F.col(time).alias("start_time"),
        *[F.col(f"_candles.{p}").alias(f"{p}s") for p in PRICES],
    )


def scale_features(
    runs: DataFrame,
    n: int,
    every: timedelta = HOUR,
    stride: int = 1,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    block: timedelta = BLOCK_WIDTH,
) -> DataFrame:
    """Log return, population std and mean size of the step returns, and relative range, per window."""
    keys = [*by, BLOCK]
    ahead = Window.partitionBy(*keys).orderBy(time)
    whole, inner = ahead.rowsBetween(0, n - 1), ahead.rowsBetween(1, n - 1)
    halo = _with_halo(runs, n, every, by, time, block).select(
        *keys, time, *PRICES, "row_index", "run_end_index", (F.col(BLOCK) == F.col("_own_block")).alias("_own")
    )
    stepped = halo.withColumn("_r", F.ln(F.col("close") / F.lag("close").over(ahead)))
    described = stepped.withColumns(
        {
            "_c": F.last("close").over(whole),
            "_high": F.max("high").over(whole),
            "_low": F.min("low").over(whole),
            "volatility": F.stddev_pop("_r").over(inner),
            "mean_abs_return": F.avg(F.abs("_r")).over(inner),
        }
    )
    kept = stride_filter(described.where(F.col("_own") & is_start(n)), stride, "row_index")
    return kept.select(
        *by,
        F.col("row_index").alias("start_index"),
        F.col(time).alias("start_time"),
        F.ln(F.col("_c") / F.col("open")).alias("log_return"),
        "volatility",
        "mean_abs_return",
        ((F.col("_high") - F.col("_low")) / F.col("_c")).alias("range_ratio"),
    )


def shape_features(arrays: DataFrame, out: str = "shape") -> DataFrame:
    """All prices of the window (opens, highs, lows, closes) scaled to the window's own range."""
    prices = F.concat(*[F.col(f"{p}s") for p in PRICES])

    def scaled(p: Column) -> Column:
        bounds = F.struct(F.array_min(p).alias("low"), F.array_max(p).alias("high"))

        def scale(edge: Column) -> Column:
            width = F.greatest(edge["high"] - edge["low"], F.lit(TINY))
            return F.transform(p, lambda x: (x - edge["low"]) / width)

        return let(bounds, scale)

    return arrays.withColumn(out, let(prices, scaled))


def candle_geometry(df: DataFrame) -> DataFrame:
    """Body, wick and colour of each candle; an unchanged price counts as rising."""
    o, h, l, c = (F.col(p) for p in PRICES)
    low, high = F.least(o, c), F.greatest(o, c)
    return df.withColumns(
        {
            "body_low": low,
            "body_high": high,
            "body_mid": (low + high) / 2,
            "wick_low": l,
            "wick_high": h,
            "rising": o <= c,
        }
    )


def padded_geometry(arrays: DataFrame, x_margin: float = 0.5, y_margin: float = 0.02) -> DataFrame:
    """One row per candle of each window, flat bodies lifted, plus the window's axis limits.

    A flat body gets 0.1 % of the window's price span as height, at least ``1e-12``.
    """
    low, high = F.array_min("lows"), F.array_max("highs")
    span = F.greatest(high - low, F.lit(TINY))
    axis = F.greatest(high - low, F.abs(high) * 1e-6, F.lit(TINY))
    keys = [c for c in arrays.columns if c not in {f"{p}s" for p in PRICES}]
    framed = arrays.withColumns(
        {
            "_lift": F.greatest(span * 0.001, F.lit(TINY)),
            "axis_x_low": F.lit(-x_margin),
            "axis_x_high": F.size("opens") - 1 + F.lit(x_margin),
            "axis_y_low": low - axis * y_margin,
            "axis_y_high": high + axis * y_margin,
        }
    )
    zipped = F.arrays_zip(*[F.col(f"{p}s").alias(p) for p in PRICES])
    limits = ["axis_x_low", "axis_x_high", "axis_y_low", "axis_y_high"]
    candles = framed.select(*keys, "_lift", *limits, F.posexplode(zipped).alias("position", "_c"))
    body_low, top = F.least("_c.open", "_c.close"), F.greatest("_c.open", "_c.close")
    body_high = F.when(top == body_low, body_low + F.col("_lift")).otherwise(top)
    return candles.select(
        *keys,
        "position",
        body_low.alias("body_low"),
        body_high.alias("body_high"),
        ((body_low + body_high) / 2).alias("body_mid"),
        F.col("_c.low").alias("wick_low"),
        F.col("_c.high").alias("wick_high"),
        (F.col("_c.close") >= F.col("_c.open")).alias("rising"),
        *limits,
    )
