"""Soft labels, certainty weights, outlier flags and class weights.

Everything fitted comes from training rows only and stays in the plan as a scalar or as a map
with one entry per class; nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeweave.functions import vectors as V
from regimeweave.operators.lookups import class_rows, with_lookup
from regimeweave.operators.quality import require_none
from regimeweave.operators.quantiles import exact_quantile

DIST = "target_distances"
SOFT = "target_soft"


@dataclass(frozen=True)
class SoftConfig:
    """Settings of the soft-target step; values outside their range are refused."""

    temperature_multiplier: float = 1.0
    outlier_percentile: float = 99.0
    certainty_floor: float = 0.10
    absolute_tolerance: float = 1e-8
    relative_tolerance: float = 1e-4
    seed: int = 42

    def __post_init__(self) -> None:
        if not self.temperature_multiplier > 0:
            raise ValueError("temperature_multiplier must be positive")
        if not 90 <= self.outlier_percentile <= 100:
            raise ValueError("outlier_percentile must lie between 90 and 100")
        if not 0 <= self.certainty_floor <= 1:
            raise ValueError("certainty_floor must lie between 0 and 1")
        if self.absolute_tolerance < 0 or self.relative_tolerance < 0:
            raise ValueError("tolerances must not be negative")


def with_order(df: DataFrame, distances: str = DIST) -> DataFrame:
    """First, second and third regime with distances, the gap, and the gaps in percent of the nearest."""
    r = df.withColumn("_r", V.ranked(F.col(distances)))
    d1, d2, d3 = (F.col("_r")[i]["distance"] for i in range(3))
    base = F.greatest(d1, F.lit(V.TINY))
    return r.withColumns(
        {
            "nearest_cluster_id": F.col("_r")[0]["id"],
            "second_nearest_cluster_id": F.col("_r")[1]["id"],
            "third_nearest_cluster_id": F.try_element_at("_r", F.lit(3))["id"],
            "nearest_distance": d1,
            "second_nearest_distance_recomputed": d2,
            "third_nearest_distance": F.try_element_at("_r", F.lit(3))["distance"],
            "nearest_second_gap": d2 - d1,
            "nearest_second_gap_percent": 100.0 * (d2 - d1) / base,
            "nearest_third_gap_percent": 100.0 * (F.try_element_at("_r", F.lit(3))["distance"] - d1) / base,
        }
    ).drop("_r")


def near_tie_audit(
    df: DataFrame,
    distances: str = DIST,
    label: str = "target_cluster_id",
    absolute: float = 1e-8,
    relative: float = 1e-4,
) -> DataFrame:
    """Compare the stored label with the nearest centroid; adds five audit columns and ``material_disagreement``."""
    nearest = V.argmax(F.transform(distances, lambda x: -x))
    d1 = F.array_min(distances)
    own = F.col(distances)[F.col(label)]
    gap = own - d1
    base = F.greatest(d1, F.lit(V.TINY))
    differs = F.col(label) != nearest
    return df.withColumns(
        {
            "source_hard_label_matches_recorded_nearest": ~differs,
            "source_hard_label_near_tie_disagreement": differs,
            "source_hard_label_distance": own,
            "source_hard_label_distance_gap": gap,
            "source_hard_label_distance_gap_percent": 100.0 * gap / base,
            "material_disagreement": differs & (gap > F.lit(absolute) + F.lit(relative) * base),
        }
    )


def require_label_consistency(df: DataFrame, ids: Sequence[str] = ("pair_id",), **tolerances: float) -> DataFrame:
    """Near ties keep their label; a larger disagreement stops the job."""
    audited = near_tie_audit(df, **tolerances)
    return require_none(audited, F.col("material_disagreement"), ids, "labels disagree with distances").drop(
        "material_disagreement"
    )


def near_tie_rows(audited: DataFrame, k: int = 3, distances: str = DIST) -> DataFrame:
    """The rows whose label is not the nearest centroid, their partition first."""
    return audited.where("source_hard_label_near_tie_disagreement").select(
        F.col("partition").alias("source_partition"),
        "pair_id",
        "target_cluster_id",
        "nearest_cluster_id",
        *[F.col(distances)[i].alias(f"target_distance_cluster_{i}") for i in range(k)],
        "source_hard_label_distance",
        "source_hard_label_distance_gap",
        "source_hard_label_distance_gap_percent",
    )


def gap_column(distances: str = DIST) -> Column:
    ordered = F.array_sort(F.col(distances))
    return ordered[1] - ordered[0]


def _or_none(found: Column, value: Column, message: str, on_none: str) -> Column:
    """``value`` where ``found``; elsewhere the job stops, or with ``on_none='null'`` there is no value."""
    if on_none not in ("raise", "null"):
        raise ValueError("on_none must be 'raise' or 'null'")
    kept = F.when(found, value)
    return kept.otherwise(F.raise_error(F.lit(message))) if on_none == "raise" else kept


def temperature(
    train: DataFrame, multiplier: float = 1.0, distances: str = DIST, above: float = V.TINY, on_none: str = "raise"
) -> DataFrame:
    """Median positive nearest-to-second gap of the training rows, times ``multiplier``; one row.

    Without such a gap the job stops; ``on_none='null'`` gives a null temperature.
    """
    gap = gap_column(distances)
    median = exact_quantile(train, F.when(gap > above, gap), 0.5, out="_median")
    tau = _or_none(F.col("_median").isNotNull(), F.col("_median") * multiplier, "no positive distance gap in training", on_none)
    return median.agg(F.max("_median").alias("_median")).select(tau.alias("temperature"))


def class_limits(
    train: DataFrame, classes: Sequence[int], percentile: float, by: str = "nearest_cluster_id", value: str = "nearest_distance"
) -> DataFrame:
    """Per class the ``percentile`` (0..100) of the nearest distance on training rows."""
    return exact_quantile(train, value, percentile / 100.0, by, classes, "distance_limit")


def require_all_classes(table: DataFrame, key: str, classes: Sequence[int], message: str) -> DataFrame:
    """Stop when a class has no row in ``table``."""
    wanted = table.sparkSession.range(1).select(class_rows(classes, key))
    return require_none(wanted.join(table.select(key), key, "left_anti"), F.lit(True), [key], message)


def with_memberships(df: DataFrame, tau: DataFrame, distances: str = DIST, out: str = SOFT) -> DataFrame:
    """Soft memberships for the one-row table ``tau``."""
    held = df.withColumn("temperature", tau.scalar())
    return held.withColumn(out, V.gibbs(F.col(distances), F.col("temperature")))


def with_certainty(df: DataFrame, k: int, floor: float = 0.10, soft: str = SOFT) -> DataFrame:
    """Entropy, entropy relative to ``ln k``, certainty and the certainty weight."""
    out = df.withColumn("soft_target_entropy", V.entropy(F.col(soft)))
    out = out.withColumn("soft_target_normalized_entropy", F.col("soft_target_entropy") / math.log(k))
    spread = F.col("soft_target_normalized_entropy")
    out = out.withColumn("soft_target_certainty", F.when(spread.isNotNull(), V.clip(1.0 - spread, 0.0, 1.0)))
    return out.withColumn("certainty_weight", floor + (1.0 - floor) * F.col("soft_target_certainty"))


def flag_outliers(
    df: DataFrame, limits: DataFrame, classes: Sequence[int], by: str = "nearest_cluster_id", value: str = "nearest_distance"
) -> DataFrame:
    """Strictly farther than its class limit: an outlier, not eligible for training."""
    limited = with_lookup(
        df, limits.withColumnRenamed(by, "_class"), "_class", "distance_limit", classes, "cluster_outlier_distance_limit", by
    )
    outlier = F.col(value) > F.col("cluster_outlier_distance_limit")
    return limited.withColumns(
        {
            "is_training_distance_outlier": outlier,
            "training_eligible": ~outlier,
            "exclusion_reason": F.when(outlier, F.lit("cluster_membership_distance_outlier")).otherwise(F.lit("retained")),
        }
    )


def annotate(
    pairs: DataFrame,
    classes: Sequence[int],
    config: SoftConfig = SoftConfig(),
    limits_by: str = "nearest_cluster_id",
    tau: DataFrame | None = None,
    limits: DataFrame | None = None,
    on_none: str = "raise",
) -> DataFrame:
    """All soft-target columns of every pair, fitted on ``partition = 'train'`` unless given.

    Training rows without a positive distance gap stop the job; with ``on_none='null'`` entropy and certainty
    are null then, and memberships hold nulls.
    """
    ordered = with_order(pairs)
    train = ordered.where("partition = 'train'")
    tau = temperature(train, config.temperature_multiplier, on_none=on_none) if tau is None else tau
    limits = class_limits(train, classes, config.outlier_percentile, limits_by) if limits is None else limits
    soft = with_certainty(with_memberships(ordered, tau), len(classes), config.certainty_floor)
    return flag_outliers(soft, limits, classes, limits_by)


def retained(annotated: DataFrame) -> DataFrame:
    return annotated.where("partition = 'train' and training_eligible")


def soft_class_weights(
    train: DataFrame, classes: Sequence[int], soft: str = SOFT, by: Sequence[str] = (), on_none: str = "raise"
) -> DataFrame:
    """``N / (K * mass_k)`` per class; a class without mass stops the job, or with ``on_none='null'`` has a null weight."""
    k = len(classes)
    sums = train.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(F.col(soft)[i]) for i in range(k)]).alias("_mass")
    )
    rows = sums.select(*by, "_n", F.posexplode("_mass").alias("cluster_id", "soft_class_mass"))
    mass = F.col("soft_class_mass")
    weight = _or_none(mass > V.TINY, F.col("_n") / (k * mass), "a class has no soft training mass", on_none)
    return rows.select(*by, "cluster_id", "soft_class_mass", weight.alias("soft_class_weight"))


def class_counts(df: DataFrame, label: str, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Rows per class with absent classes as zero; one aggregation, one counter per class."""
    counted = df.groupBy(*by).agg(F.array(*[F.count_if(F.col(label) == c) for c in classes]).alias("_c"))
    names = F.array(*[F.lit(c) for c in classes])
    return counted.select(*by, F.explode(F.arrays_zip(names.alias("k"), F.col("_c").alias("n"))).alias("_z")).select(
        *by, F.col("_z.k").alias("cluster_id"), F.col("_z.n").alias("count")
    )


def class_weights(train: DataFrame, classes: Sequence[int], label: str = "target_cluster_id", on_zero: str = "raise") -> DataFrame:
    """``N / (K * n_k)`` per class. ``on_zero='floor'`` counts an absent class as one row, ``'drop'`` leaves it out."""
    k = len(classes)
    array = F.array(*[F.count_if(F.col(label) == c) for c in classes])
    counted = train.agg(F.count(F.lit(1)).alias("_n"), array.alias("_c"))
    rows = counted.select("_n", F.posexplode("_c").alias("_p", "count"))
    if on_zero == "raise":
        weight = F.when(F.col("count") > 0, F.col("_n") / (k * F.col("count"))).otherwise(
            F.raise_error(F.lit("a class is absent from training"))
        )
    elif on_zero == "floor":
        weight = F.col("_n") / (k * F.greatest("count", F.lit(1)))
    elif on_zero == "drop":
        rows = rows.where("count > 0")
        weight = F.col("_n") / (k * F.col("count"))
    else:
        raise ValueError("on_zero must be 'raise', 'floor' or 'drop'")
    ids = F.array(*[F.lit(c) for c in classes])
    return rows.select(ids[F.col("_p")].alias("cluster_id"), "count", weight.alias("class_weight"))


def mass_report(annotated: DataFrame, classes: Sequence[int], soft: str = SOFT) -> DataFrame:
    """Per partition and class: labels, nearest centroids and soft mass, with percentages."""
    k = len(classes)
    counted = annotated.groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("target_cluster_id") == c).alias(f"_h{c}") for c in classes],
        *[F.count_if(F.col("nearest_cluster_id") == c).alias(f"_g{c}") for c in classes],
        *[F.sum(F.col(soft)[i]).alias(f"_m{c}") for i, c in enumerate(classes)],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("cluster_id"),
                F.col(f"_h{c}").alias("hard_count"),
                F.col(f"_g{c}").alias("nearest_count"),
                F.col(f"_m{c}").alias("soft_mass"),
            )
            for c in classes
        ]
    )
    all_mass = sum((F.col(f"_m{c}") for c in classes[1:]), F.col(f"_m{classes[0]}"))
    rows = counted.select("partition", "rows", all_mass.alias("_all"), F.explode(entries).alias("_e"))
    return rows.select(
        "partition",
        F.col("_e.cluster_id"),
        F.col("_e.hard_count"),
        (100.0 * F.col("_e.hard_count") / F.col("rows")).alias("hard_percentage"),
        F.col("_e.nearest_count"),
        (100.0 * F.col("_e.nearest_count") / F.col("rows")).alias("nearest_percentage"),
        F.col("_e.soft_mass").alias("soft_membership_mass"),
        (100.0 * F.col("_e.soft_mass") / F.col("_all")).alias("soft_mass_percentage"),
        "rows",
    )


def uncertainty_report(annotated: DataFrame, partitions: Sequence[str], soft: str = SOFT) -> DataFrame:
    """Per partition: mean and median of the largest membership and of the entropy, flat rows, outliers."""
    top = annotated.withColumn("_top", F.array_max(soft))
    means = top.groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("_top").alias("mean_max_membership"),
        F.avg("soft_target_normalized_entropy").alias("mean_normalized_entropy"),
        F.count_if(F.col("_top") <= 0.40).alias("near_uniform_rows"),
        F.count_if("is_training_distance_outlier").alias("training_distance_outliers"),
    )
    tops = exact_quantile(top, "_top", 0.5, "partition", partitions, "median_max_membership")
    flats = exact_quantile(top, "soft_target_normalized_entropy", 0.5, "partition", partitions, "median_normalized_entropy")
    return means.join(tops, "partition").join(flats, "partition")


def soft_violations(df: DataFrame, soft: str = SOFT, distances: str = DIST, tolerance: float = 1e-9) -> DataFrame:
    """Adds flags: memberships off one, largest membership not the nearest, recomputation differs."""
    again = V.gibbs(F.col(distances), F.col("temperature"))
    worst = F.array_max(F.zip_with(F.col(soft), again, lambda a, b: F.abs(a - b)))
    nearest = V.argmax(F.transform(distances, lambda x: -x))
    return df.withColumns(
        {
            "sum_violation": F.abs(V.total(F.col(soft)) - 1.0) > tolerance,
            "argmax_violation": V.argmax(F.col(soft)) != nearest,
            "recompute_violation": worst > tolerance,
        }
    )


def check_weights(
    saved: DataFrame, train: DataFrame, classes: Sequence[int], atol: float = 1e-9, rtol: float = 1e-9, on_none: str = "raise"
) -> DataFrame:
    """Saved class weights next to recomputed ones, with a flag for agreement and positivity.

    With ``on_none='null'`` a class without mass has no weight, and only a saved null agrees with that.
    """
    fresh = soft_class_weights(train, classes, on_none=on_none)
    joined = fresh.join(saved.select("cluster_id", F.col("soft_class_weight").alias("saved_weight")), "cluster_id", "left")
    close = F.abs(F.col("saved_weight") - F.col("soft_class_weight")) <= atol + rtol * F.abs("soft_class_weight")
    finite = (F.col("saved_weight") > 0) & (F.col("saved_weight") < float("inf"))
    neither = F.col("saved_weight").isNull() & F.col("soft_class_weight").isNull()
    return joined.withColumn("agrees", neither | F.coalesce(close & finite, F.lit(False)))
