"""One evaluation per stride in a single job instead of a loop over strides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeweave.operators.baselines import fit_rules
from regimeweave.operators.lookups import class_map


def stride_frames(pairs: DataFrame, strides: Sequence[int], column: str = "input_start_index") -> DataFrame:
    """Each pair once per stride that divides its start index."""
    fits = F.filter(F.array(*[F.lit(s) for s in strides]), lambda s: F.pmod(F.col(column), s) == 0)
    return pairs.withColumn("stride", F.explode(fits))


def with_stride_baselines(
    frames: DataFrame,
    train: DataFrame,
    strides: Sequence[int],
    classes: Sequence[int],
    current: str = "input_cluster_id",
    label: str = "target_cluster_id",
) -> DataFrame:
    """Majority, persistence and transition predictions, fitted per stride on ``train``."""
    # one entry per stride
    fitted = fit_rules(train, classes, current, label, ["stride"])
    rules = class_map(fitted, "stride", F.struct("majority_class", "next_class"), strides)
    held = frames.withColumn("_all", rules.scalar()).withColumn("_rules", F.try_element_at("_all", F.col("stride")))
    return held.withColumns(
        {
            "majority": F.col("_rules.majority_class"),
            "persistence": F.col(current),
            "transition": F.try_element_at("_rules.next_class", F.col(current)),
        }
    ).drop("_all", "_rules")
