"""Geometric confidence filter and temporally spread class balancing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regimeweave.functions import vectors as V
from regimeweave.functions.timing import id_block
from regimeweave.operators.lookups import class_map, with_lookup
from regimeweave.operators.ordering import with_position
from regimeweave.operators.quality import require_none
from regimeweave.operators.quantiles import exact_quantile
from regimeweave.operators.regimes import center_array
from regimeweave.operators.soft_targets import DIST, class_counts, with_order

# thresholds of the coverage sweep
SWEEP = (0.0, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90)


@dataclass(frozen=True)
class BalanceConfig:
    """Settings of the confidence filter."""

    confidence_threshold: float = 0.5
    membership_percentile: float = 95.0
    seed: int = 42

    def __post_init__(self) -> None:
        if not 0 <= self.confidence_threshold <= 1:
            raise ValueError("confidence_threshold must lie between 0 and 1")
        if not 90 <= self.membership_percentile <= 100:
            raise ValueError("membership_percentile must lie between 90 and 100")


def with_confidence(
    pairs: DataFrame, centroids: DataFrame, label: str = "target_cluster_id", check: bool = True
) -> DataFrame:
    """Distance order, separation per competitor, and the smallest separation as confidence.

    A competitor's separation is its extra distance divided by the distance between the two
    centroids, clipped to 0..1. Here a label that is not the nearest centroid is an error.
    """
    ordered = with_order(pairs)
    if check:
        require_none(ordered, F.col(label) != F.col("nearest_cluster_id"), ["pair_id"], "labels are not the nearest centroid")
    grid = center_array(centroids).select(
        F.transform("centers", lambda c: V.distances_to(c, F.col("centers"))).alias("grid")
    )
    held = ordered.withColumn("_grid", grid.scalar()).withColumn("_row", F.col("_grid")[F.col("nearest_cluster_id")])
    own = F.struct(
        F.col("nearest_cluster_id").alias("id"), F.col("nearest_distance").alias("d1"), F.col("_row").alias("row")
    )

    def separations(o):
        return F.transform(
            DIST, lambda d, j: F.when(j != o["id"], V.clip((d - o["d1"]) / o["row"][j], 0.0, 1.0))
        )

    held = held.withColumn("_q", V.let(own, separations))
    return held.withColumns(
        {
            "assigned_to_second_centroid_distance": F.col("_row")[F.col("second_nearest_cluster_id")],
            "assigned_to_third_centroid_distance": F.col("_row")[F.col("third_nearest_cluster_id")],
            "confidence_vs_second": F.col("_q")[F.col("second_nearest_cluster_id")],
            "confidence_vs_third": F.col("_q")[F.col("third_nearest_cluster_id")],
            "geometric_confidence": F.array_min("_q"),
        }
    ).drop("_grid", "_row", "_q")


def membership_limits(train: DataFrame, classes: Sequence[int], percentile: float, label: str = "target_cluster_id") -> DataFrame:
    """Per class the ``percentile`` of the nearest distance on training rows."""
    return exact_quantile(train, "nearest_distance", percentile / 100.0, label, classes, "distance_limit")


def apply_rules(
    df: DataFrame, threshold: float, limits: DataFrame, classes: Sequence[int], label: str = "target_cluster_id"
) -> DataFrame:
    """Accept rows that are separated well enough and lie within their class limit."""
    held = with_lookup(
        df, limits.withColumnRenamed(label, "_class"), "_class", "distance_limit", classes,
        "cluster_membership_distance_limit", label,
    )
    apart = F.col("geometric_confidence") >= threshold
    inside = F.col("nearest_distance") <= F.col("cluster_membership_distance_limit")
    reason = (
        F.when(apart & inside, F.lit("accepted"))
        .when(inside, F.lit("insufficient_centroid_separation"))
        .when(apart, F.lit("cluster_membership_outlier"))
        .otherwise(F.lit("insufficient_centroid_separation_and_membership_outlier"))
    )
    return held.withColumns(
        {
            "confidence_threshold": F.lit(float(threshold)),
            "passes_centroid_separation": apart,
            "passes_cluster_membership": inside,
            "confidence_accepted": apart & inside,
            "rejection_reason": reason,
        }
    )


def temporal_balance(
    accepted: DataFrame, classes: Sequence[int], label: str = "target_cluster_id", block_size: int = 1_000_000
) -> DataFrame:
    """As many rows of every class as the smallest class has, spread over time.

    The rows of a class are cut, in time order, into as many equal segments as the smallest
    class has rows; the most confident row of each segment stays. A segment may be a whole
    class, so the choice is an aggregation with partial results, not a sort of the segment.
    """
    counts = class_counts(accepted, label, classes)
    sizes = class_map(counts, "cluster_id", "count", classes)
    placed = with_position(
        accepted, [label], ["chronological_rank", "pair_id"], id_block(F.col("chronological_rank"), block_size), "_i"
    )
    held = placed.withColumn("_sizes", sizes.scalar()).withColumns(
        {"_n": F.col("_sizes")[F.col(label)], "_m": F.array_min(F.map_values("_sizes"))}
    )
    absent = F.raise_error(F.lit("a class has no accepted training row"))
    held = held.withColumn("_m", F.when(F.col("_m") > 0, F.col("_m")).otherwise(absent))
    # the first `wide` segments hold one row more than the rest
    held = held.withColumns({"_q": F.expr("_n div _m"), "_wide": F.expr("_n % _m")})
    held = held.withColumn(
        "_segment",
        F.expr("if(_i < _wide * (_q + 1), _i div (_q + 1), _wide + (_i - _wide * (_q + 1)) div _q)"),
    )
    best = F.min_by(F.struct(*accepted.columns), F.struct(-F.col("geometric_confidence"), "chronological_rank", "pair_id"))
    return held.groupBy(label, "_segment").agg(best.alias("_row")).select("_row.*")


def balance_excluded(accepted: DataFrame, balanced: DataFrame) -> DataFrame:
    """Accepted rows that balancing left out."""
    return accepted.join(balanced.select("pair_id"), "pair_id", "left_anti").withColumn(
        "balance_exclusion_reason", F.lit("confident_sample_not_selected_by_temporal_spread_undersampling")
    )


def stage_counts(stages: dict[str, DataFrame], classes: Sequence[int], label: str = "target_cluster_id") -> DataFrame:
    """Rows and percent per stage, partition and class, absent classes as zero."""
    parts = [
        class_counts(df, label, classes, ["partition"]).withColumn("stage", F.lit(name)) for name, df in stages.items()
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    total = F.sum("count").over(Window.partitionBy("stage", "partition"))
    return rows.withColumn("total_rows", total).withColumn(
        "percentage", 100.0 * F.col("count") / F.greatest(F.col("total_rows"), F.lit(1))
    )


def threshold_sweep(
    df: DataFrame,
    limits: DataFrame,
    classes: Sequence[int],
    thresholds: Sequence[float] = SWEEP,
    partitions: Sequence[str] = ("train", "validation"),
    label: str = "target_cluster_id",
) -> DataFrame:
    """Coverage per threshold, partition and class, in one pass. The test partition is left out on purpose."""
    held = with_lookup(
        df.where(F.col("partition").isin(list(partitions))),
        limits.withColumnRenamed(label, "_class"), "_class", "distance_limit", classes, "_limit", label,
    )
    inside = F.col("nearest_distance") <= F.col("_limit")
    counted = held.groupBy("partition", label).agg(
        F.count(F.lit(1)).alias("_all"),
        F.array(*[F.count_if(inside & (F.col("geometric_confidence") >= t)) for t in thresholds]).alias("_ok"),
    )
    # at most partitions x classes rows from here on
    cells = counted.groupBy("partition").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(label), F.struct("_all", "_ok")))).alias("_cells")
    )
    grid = cells.select("partition", "_cells", F.posexplode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("_t", "threshold"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(c) for c in classes])).alias("cluster_id"))
    cell = F.try_element_at("_cells", F.col("cluster_id"))
    sized = grid.select(
        "threshold",
        "partition",
        "cluster_id",
        F.coalesce(cell["_all"], F.lit(0)).alias("original_count"),
        F.coalesce(cell["_ok"][F.col("_t")], F.lit(0)).alias("accepted_count"),
    )
    whole = Window.partitionBy("threshold", "partition")
    accepted, rows = F.sum("accepted_count").over(whole), F.sum("original_count").over(whole)
    return sized.select(
        "*",
        (100.0 * F.col("accepted_count") / F.greatest(F.col("original_count"), F.lit(1))).alias("cluster_coverage_percent"),
        accepted.alias("partition_accepted_total"),
        (100.0 * accepted / rows).alias("partition_coverage_percent"),
    )


def rejection_report(checked: DataFrame) -> DataFrame:
    """Rejected rows per partition and reason, with their percent of the partition."""
    counts = checked.groupBy("partition", "rejection_reason").agg(F.count(F.lit(1)).alias("count"))
    share = 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("partition"))
    return counts.withColumn("percentage_of_partition", share).where("rejection_reason <> 'accepted'")
