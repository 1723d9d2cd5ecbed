"""Comparison tables, model selection and seed summaries. Inputs are reports, a few rows each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(results: dict[str, DataFrame], name: str = "experiment", split: str = "partition") -> DataFrame:
    """All result tables in one, by split, best macro-F1 first; columns a table lacks are null."""
    tagged = [df.withColumn(name, F.lit(key)) for key, df in results.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return rows.orderBy(split, F.col("macro_f1").desc(), name)


def select_model(scores: DataFrame, order: str = "listing_order", by_split: str = "partition") -> DataFrame:
    """Best validation macro-F1; the model listed first wins a tie. Test rows are never looked at."""
    return scores.where(F.col(by_split) == "validation").orderBy(F.col("macro_f1").desc(), order).limit(1)


def seed_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample standard deviation of macro-F1 over seeds."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seeds"),
        F.avg("macro_f1").alias("mean_macro_f1"),
        F.stddev_samp("macro_f1").alias("sd_macro_f1"),
    )
