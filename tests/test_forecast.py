"""The composed jobs on a candle table with several symbols and gaps."""

import math
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from regimeweave.operators import regimes
from regimeweave.operators.quality import GateError
from regimeweave.plans import forecast
from tests.helpers import START, candles

HOUR = timedelta(hours=1)


@pytest.fixture(scope="module")
def table(spark):
    def wave(phase):
        return lambda i: 100 * math.exp(0.5 * math.sin(i / 11 + phase))

    a = candles(spark, range(300), "A", wave(0))
    b = candles(spark, [h for h in range(300) if h not in (120, 121)], "B", wave(2))
    return a.unionByName(b).cache()


def test_from_candles_to_scores(spark, table):
    centers = regimes.centroid_table(spark, [[0.3, 0.04], [0.0, 0.04], [-0.3, 0.04]])
    labelled = forecast.labelled_windows(forecast.checked_candles(table), centers, 10, block=timedelta(days=2))
    assert {r.symbol: r["count"] for r in labelled.groupBy("symbol").count().collect()} == {"A": 291, "B": 111 + 169}
    bounds = {
        "train": (START, START + 199 * HOUR),
        "validation": (START + 200 * HOUR, START + 249 * HOUR),
        "test": (START + 250 * HOUR, START + 299 * HOUR),
    }
    pairs = forecast.forecast_pairs(labelled, 10, bounds)
    sizes = {(r.symbol, r.partition): r["count"] for r in pairs.groupBy("symbol", "partition").count().collect()}
    assert sizes[("A", "train")] == 181 and sizes[("A", "test")] == 31 and sizes[("B", "train")] == 101 + 59
    # a pair never reaches into the next period, and never crosses a gap
    assert pairs.where(F.col("target_stop_time") - F.col("input_start_time") != F.expr("interval 19 hours")).count() == 0
    soft = forecast.soft_dataset(pairs, range(3))
    assert soft.count() == pairs.count() and soft.where("certainty_weight < 0.1 or certainty_weight > 1").count() == 0
    parts = forecast.balanced_dataset(pairs, centers, range(3))
    sizes = {r["count"] for r in parts["balanced"].groupBy("target_cluster_id").count().collect()}
    assert len(sizes) == 1 and parts["accepted"].count() >= parts["balanced"].count()
    scores = forecast.baseline_scores(pairs, range(3)).collect()
    assert len(scores) == 9 and all(0 <= r.macro_f1 <= 1 for r in scores)


def test_gates_run_first(spark, table):
    with pytest.raises(GateError, match="duplicate timestamps"):
        forecast.checked_candles(table.unionByName(table.limit(1)))
    with pytest.raises(GateError, match="invalid OHLC"):
        forecast.checked_candles(table.withColumn("low", F.lit(0.0)))
