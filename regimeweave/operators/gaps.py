"""Gaps, missing slots and gap-free runs of a candle table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regimeweave.functions.predicates import ohlc_invalid
from regimeweave.functions.timing import elapsed_seconds, interval, time_block
from regimeweave.operators.ordering import BLOCK, contiguous_ranges, running

HOUR = timedelta(hours=1)
BLOCK_WIDTH = timedelta(days=30)


def with_runs(
    candles: DataFrame,
    every: timedelta = HOUR,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    block: timedelta = BLOCK_WIDTH,
) -> DataFrame:
    """Number the candles of each symbol and tell each one where its gap-free run ends.

    Adds ``row_index``, ``max_index``, ``prev_time``, ``next_time`` and, for the last candle
    of the run, ``run_end_index``, ``run_end_time``, ``run_end_next`` (first candle after the
    gap, null at the end of the series). A window of ``n`` candles is gap-free exactly when
    ``run_end_index - row_index >= n - 1``, for any ``n``. ``(by, time)`` must be unique.
    """
    keys = [*by, BLOCK]
    t = F.col(time)
    step = interval(every)
    ahead = Window.partitionBy(*keys).orderBy(time)
    local = candles.withColumn(BLOCK, time_block(t, block)).withColumns(
        {"_local": F.row_number().over(ahead), "_next": F.lead(time).over(ahead), "_prev": F.lag(time).over(ahead)}
    )

    def stop(position, at, then):
        return F.struct(position.cast("bigint").alias("index"), at.alias("at"), then.alias("then"))

    inner_gap = F.col("_next").isNotNull() & ((F.col("_next") - t) != step)
    blocks = local.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(time).alias("_first"),
        F.max(time).alias("_last"),
        F.min(F.when(inner_gap, stop(F.col("_local"), t, F.col("_next")))).alias("_gap"),
    )
    in_order = Window.partitionBy(*by).orderBy(BLOCK)
    blocks = blocks.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(running(by, BLOCK, before=True)), F.lit(0)),
            "_total": F.sum("_n").over(Window.partitionBy(*by)),
            "_next_first": F.lead("_first").over(in_order),
            "_prev_last": F.lag("_last").over(in_order),
        }
    )
    tail_gap = F.col("_next_first").isNull() | ((F.col("_next_first") - F.col("_last")) != step)
    own = F.coalesce(F.col("_gap"), F.when(tail_gap, stop(F.col("_n"), F.col("_last"), F.col("_next_first"))))
    blocks = blocks.withColumn("_own", own).withColumn(
        "_own",
        F.when(
            F.col("_own").isNotNull(),
            stop(F.col("_before") + F.col("_own.index") - 1, F.col("_own.at"), F.col("_own.then")),
        ),
    )
    blocks = blocks.select(
        *keys,
        "_before",
        "_total",
        "_next_first",
        "_prev_last",
        F.last("_own", ignorenulls=True).over(running(by, F.col(BLOCK).desc(), before=True)).alias("_later"),
    )
    placed = local.join(blocks, keys).withColumns(
        {
            "row_index": F.col("_before") + F.col("_local") - 1,
            "max_index": F.col("_total") - 1,
            "prev_time": F.coalesce("_prev", "_prev_last"),
            "next_time": F.coalesce("_next", "_next_first"),
        }
    )
    ends_here = F.col("next_time").isNull() | ((F.col("next_time") - t) != step)
    here = F.when(ends_here, stop(F.col("row_index"), t, F.col("next_time")))
    closed = placed.withColumn(
        "_end", F.coalesce(F.last(here, ignorenulls=True).over(running(keys, F.col(time).desc())), F.col("_later"))
    )
    return closed.select(
        *candles.columns,
        "row_index",
        "max_index",
        "prev_time",
        "next_time",
        F.col("_end.index").alias("run_end_index"),
        F.col("_end.at").alias("run_end_time"),
        F.col("_end.then").alias("run_end_next"),
    )


def gap_events(runs: DataFrame, every: timedelta = HOUR, by: Sequence[str] = ("symbol",), time: str = "open_time") -> DataFrame:
    """Candles whose distance to the previous candle is not ``every``."""
    gap = F.col(time) - F.col("prev_time")
    return runs.where(F.col("prev_time").isNotNull() & (gap != interval(every))).select(
        *by,
        "row_index",
        "prev_time",
        time,
        elapsed_seconds(F.col(time), F.col("prev_time")).alias("gap_seconds"),
    )


def missing_slots(
    candles: DataFrame,
    every: timedelta = HOUR,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    block: timedelta = BLOCK_WIDTH,
) -> DataFrame:
    """Times of the regular grid from the first to the last candle that have no candle.

    The grid is generated block by block, so no row ever holds a whole history.
    """
    steps = max(1, int(block / every))
    spans = candles.groupBy(*by).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    starts = spans.select(*by, "_hi", F.explode(F.sequence("_lo", "_hi", interval(every, steps))).alias("_from"))
    last = F.least(F.col("_from") + interval(every, steps - 1), F.col("_hi"))
    grid = starts.select(*by, F.explode(F.sequence(F.col("_from"), last, interval(every))).alias(time))
    return grid.join(candles.select(*by, time), [*by, time], "left_anti")


def audit_candles(
    candles: DataFrame,
    n: int,
    every: timedelta = HOUR,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    block: timedelta = BLOCK_WIDTH,
) -> DataFrame:
    """One row per symbol: size, period, duplicates, gaps, invalid candles and window counts.

    Copies of a timestamp are collapsed to a count before anything is shuffled by time. A copy
    is a zero-length step: it counts as a gap event, and a window can only begin or end on it.
    """
    stamps = candles.groupBy(*by, time).agg(
        F.count(F.lit(1)).alias("_copies"), F.count_if(ohlc_invalid()).alias("_invalid")
    )
    runs = with_runs(stamps.where(F.col(time).isNotNull()), every, by, time, block)
    gap = F.col("prev_time").isNotNull() & ((F.col(time) - F.col("prev_time")) != interval(every))
    facts = runs.groupBy(*by).agg(
        F.min(time).alias("date_start"), F.max(time).alias("date_end"), F.count_if(gap).alias("_gaps")
    )
    totals = stamps.groupBy(*by).agg(
        F.sum("_copies").alias("rows"),
        F.sum("_invalid").alias("invalid_ohlc_rows"),
        F.coalesce(F.sum(F.when(F.col(time).isNull(), F.col("_copies"))), F.lit(0)).alias("timestamps_unparseable"),
        F.coalesce(F.sum(F.when(F.col(time).isNotNull(), F.col("_copies") - 1)), F.lit(0)).alias("duplicate_timestamps"),
    )
    whole = runs.where(F.col("run_end_index") - F.col("row_index") >= n - 1).select(*by, "row_index")
    if n > 2:
        broken = (
            runs.where("_copies > 1")
            .select(*by, F.explode(F.sequence(F.col("row_index") - (n - 2), F.col("row_index") - 1)).alias("row_index"))
            .distinct()
        )
        whole = whole.join(broken, [*by, "row_index"], "left_anti")
    valid = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("_valid"))
    missing = missing_slots(candles.where(F.col(time).isNotNull()), every, by, time, block)
    missing = missing.groupBy(*by).agg(F.count(F.lit(1)).alias("_missing"))
    none = F.lit(0).cast("bigint")
    joined = totals.join(facts, [*by], "left").join(valid, [*by], "left").join(missing, [*by], "left")
    windows = F.greatest(F.col("rows") - (n - 1), none)
    return joined.select(
        *by,
        "rows",
        "date_start",
        "date_end",
        "timestamps_unparseable",
        "duplicate_timestamps",
        F.coalesce("_missing", none).alias("missing_slot_count"),
        (F.coalesce("_gaps", none) + F.col("duplicate_timestamps")).alias("gap_event_count"),
        "invalid_ohlc_rows",
        F.lit(n).cast("bigint").alias("window_size"),
        windows.alias("candidate_windows"),
        F.coalesce("_valid", none).alias("valid_windows"),
        (windows - F.coalesce("_valid", none)).alias("skipped_windows"),
    )


def skipped_start_ranges(
    runs: DataFrame, n: int, by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Contiguous ranges of window starts that a gap rules out."""
    skipped = runs.where(
        (F.col("row_index") <= F.col("max_index") - (n - 1)) & (F.col("run_end_index") - F.col("row_index") < n - 1)
    )
    return contiguous_ranges(skipped, "row_index", by)
