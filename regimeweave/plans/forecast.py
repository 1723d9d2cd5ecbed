"""The usual jobs from a candle table to a scored forecast, for any symbols, step and window length."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeweave.functions.timing import interval
from regimeweave.operators import align, baselines, geometry, metrics, regimes, reports, splits
from regimeweave.operators import soft_targets as soft
from regimeweave.operators.gaps import BLOCK_WIDTH, HOUR, with_runs
from regimeweave.operators.quality import require_unique, require_valid_ohlc
from regimeweave.operators.windows import sample_name, scale_features
from regimeweave.session import stage

LABELLED = ("symbol", "sample_name", "start_index", "stop_index", "start_time", "stop_time", "cluster_id", "distances")


def checked_candles(candles: DataFrame) -> DataFrame:
    """Candles after the gates every later step relies on: unique times, valid prices."""
    require_unique(candles, ["symbol", "open_time"], "duplicate timestamps")
    return require_valid_ohlc(candles, ["symbol", "open_time"])


def describe(runs: DataFrame, n: int, every: timedelta = HOUR, block: timedelta = BLOCK_WIDTH) -> DataFrame:
    """Window manifest with the vector (log return, volatility), in one pass over a run table."""
    features = scale_features(runs, n, every, block=block)
    stop = F.col("start_index") + (n - 1)
    return features.select(
        "symbol",
        sample_name(F.col("start_index"), stop).alias("sample_name"),
        "start_index",
        stop.alias("stop_index"),
        "start_time",
        (F.col("start_time") + interval(every, n - 1)).alias("stop_time"),
        F.array("log_return", "volatility").alias("features"),
    )


def labelled_windows(
    candles: DataFrame, centroids: DataFrame, n: int, every: timedelta = HOUR, block: timedelta = BLOCK_WIDTH
) -> DataFrame:
    """Gap-free windows with regime, distances and margins."""
    return regimes.assign(describe(with_runs(candles, every, block=block), n, every, block), "features", centroids)


def future_pairs(labelled: DataFrame, n: int, every: timedelta = HOUR) -> DataFrame:
    """Every window with the window after it. The windows are staged: both join sides read them."""
    return align.pair_windows(stage(labelled.select(*LABELLED), "labelled"), n, every)


def forecast_pairs(labelled: DataFrame, n: int, bounds: splits.Bounds, every: timedelta = HOUR) -> DataFrame:
    """Purged, split and ranked pairs as a stage table; train-fitted steps read it several times."""
    split = splits.split_fixed(future_pairs(labelled, n, every), bounds)
    return stage(reports.with_rank(split), "pairs")


def soft_dataset(pairs: DataFrame, classes: Sequence[int], config: soft.SoftConfig = soft.SoftConfig()) -> DataFrame:
    """Pairs with soft targets, certainty weights and outlier flags."""
    return soft.annotate(soft.require_label_consistency(pairs), classes, config)


def balanced_dataset(
    pairs: DataFrame, centroids: DataFrame, classes: Sequence[int], config: geometry.BalanceConfig = geometry.BalanceConfig()
) -> dict[str, DataFrame]:
    """Checked pairs, the accepted training rows, and the balanced selection of them."""
    rows = stage(geometry.with_confidence(pairs, centroids), "confidence")
    limits = geometry.membership_limits(rows.where("partition = 'train'"), classes, config.membership_percentile)
    checked = stage(geometry.apply_rules(rows, config.confidence_threshold, limits, classes), "checked")
    accepted = checked.where("confidence_accepted and partition = 'train'")
    return {"checked": checked, "accepted": accepted, "balanced": geometry.temporal_balance(accepted, classes)}


def baseline_scores(pairs: DataFrame, classes: Sequence[int], train: DataFrame | None = None) -> DataFrame:
    """Metrics of the three baseline rules per partition."""
    rows = baselines.long_predictions(baselines.with_baselines(pairs, classes, train))
    return metrics.metrics(rows, len(classes), ["partition", "rule"])
