"""Candles, labelled windows and pairs derived from the event stream.

The event table has no candles, so bars are cut from it first. This adapter stands in for the
exchange feed, which delivers bars already.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, ShortType, TimestampNTZType, TimestampType

from regimeweave.functions.predicates import ohlc_invalid
from regimeweave.functions.timing import packed_order
from regimeweave.operators import regimes, soft_targets
from regimeweave.operators.gaps import HOUR, with_runs
from regimeweave.operators.windows import build_windows
from regimeweave.plans import forecast
from regimeweave.session import stage

N = 30
CLASSES = (0, 1, 2)
K = len(CLASSES)

# frozen regime centers on (log return, volatility)
CENTERS = ((1.5, 1.6), (0.0, 1.6), (-1.5, 1.6))

# inclusive periods: input start, target end
PERIODS = {
    "train": (datetime(2024, 1, 1, 0), datetime(2024, 1, 20, 23)),
    "validation": (datetime(2024, 1, 21, 0), datetime(2024, 1, 25, 23)),
    "test": (datetime(2024, 1, 26, 0), datetime(2024, 1, 30, 23)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(
    spark: SparkSession, sf_dir: str, by_type: bool = False, every: timedelta = HOUR, valid: bool = True
) -> DataFrame:
    """OHLC bars of the event values, one symbol per event type or one for all events.

    Events merge into partial bars before the shuffle, so a symbol with most of the events
    costs no more than any other. Event order inside a bar is (time, id). All events
    enter; with ``valid``, bars that fail the price rules are left out, as ``B6_ohlc_invalid`` counts them.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    symbol = F.col("event_type") if by_type else F.lit("ALL")
    start = F.window("ts", f"{int(every.total_seconds())} seconds").start
    order = packed_order(F.col("ts"), F.col("event_id"))
    made = (
        events.withColumn("symbol", symbol)
        .groupBy("symbol", start.alias("open_time"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
        )
    )
    return made.where(~ohlc_invalid()) if valid else made


def candles(spark: SparkSession, sf_dir: str, by_type: bool = False, every: timedelta = HOUR, valid: bool = True) -> DataFrame:
    """Bars as a stage table: the events are scanned once, whatever follows."""
    return stage(bars(spark, sf_dir, by_type, every, valid), "candles")


def runs(spark: SparkSession, sf_dir: str, by_type: bool = False, every: timedelta = HOUR) -> DataFrame:
    return with_runs(candles(spark, sf_dir, by_type, every), every)


def windows(spark: SparkSession, sf_dir: str, by_type: bool = False, n: int = N) -> DataFrame:
    return build_windows(runs(spark, sf_dir, by_type), n)


def describe(run_table: DataFrame, n: int = N, every: timedelta = HOUR) -> DataFrame:
    return forecast.describe(run_table, n, every)


def frozen(spark: SparkSession) -> DataFrame:
    return regimes.centroid_table(spark, CENTERS)


def labelled(spark: SparkSession, sf_dir: str, by_type: bool = False, every: timedelta = HOUR) -> DataFrame:
    """Valid windows with regime, distances and margins."""
    return forecast.labelled_windows(candles(spark, sf_dir, by_type, every), frozen(spark), N, every)


def all_pairs(spark: SparkSession, sf_dir: str, by_type: bool = False, every: timedelta = HOUR) -> DataFrame:
    """Every window with its future window, before any split."""
    return forecast.future_pairs(labelled(spark, sf_dir, by_type, every), N, every)


def pairs(spark: SparkSession, sf_dir: str, by_type: bool = False, every: timedelta = HOUR) -> DataFrame:
    """Split and ranked pairs as a stage table."""
    return forecast.forecast_pairs(labelled(spark, sf_dir, by_type, every), N, PERIODS, every)


def soft_pairs(rows: DataFrame) -> DataFrame:
    """Pairs with all soft-target columns. The more events an hour holds, the likelier one of them is zero and the bar
    fails the price rules, until no gap-free pair is left to train on; then there is no temperature, as in the check statements."""
    return soft_targets.annotate(rows, CLASSES, on_none="null")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Result columns in comparable form: rounded doubles, 64-bit integers, times as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DoubleType, FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(field.dataType, (IntegerType, ShortType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (TimestampNTZType, TimestampType)):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)
