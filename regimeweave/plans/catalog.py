"""All queries and check statements by name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from regimeweave.operators import metrics, splits
from regimeweave.plans import cases_align, cases_candles, cases_eval, cases_regimes, cases_soft
from regimeweave.plans import inputs as I

MODULES = (cases_candles, cases_align, cases_regimes, cases_soft, cases_eval)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def statements() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of the persistence rule per period on six-hour bars: bars to metrics in one job."""
    pairs = I.all_pairs(spark, sf_dir, every=timedelta(hours=6))
    split = splits.split_fixed(pairs, I.PERIODS)
    return I.tidy(metrics.metrics(split, I.K, ["partition"], "target_cluster_id", "input_cluster_id"))
