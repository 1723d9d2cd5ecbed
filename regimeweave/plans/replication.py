"""Models fitted over seeds, strides and feature sets at once, and their paired intervals against a rule."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeweave.functions import vectors as V
from regimeweave.operators import bootstrap as BB
from regimeweave.operators import metrics as MX
from regimeweave.operators.networks import Fitted, Network, fit_networks, predict_networks
from regimeweave.session import stage

SEEDS = (11, 22, 33, 44, 55)
HIDDEN = {"linear": (), "mlp": (256, 64)}
STEPS, PATIENCE, DRAWS = 40, 7, 1500


def with_soft_mass(rows: DataFrame, weights: DataFrame, out: str = "mass", soft: str = "target_soft", certainty: str = "certainty_weight") -> DataFrame:
    """Per class: certainty times class weight times soft target. ``weights`` has one row per class."""
    held = rows.withColumn("_w", weights.agg(F.sort_array(F.collect_list(F.struct("cluster_id", "soft_class_weight")))).scalar())
    return held.withColumn(out, F.zip_with(soft, "_w", lambda s, w: s * w["soft_class_weight"] * F.col(certainty))).drop("_w")


def grid(groups: dict[str, tuple[str, str, int]], classes: Sequence[int], kinds: Sequence[str] = tuple(HIDDEN), seeds: Sequence[int] = SEEDS) -> list[Network]:
    """One model per group, kind and seed; a group names its features column, its target column and the width."""
    return [
        Network(f"{group}/{kind}/{seed}", features, target, width, len(classes), HIDDEN[kind], seed)
        for group, (features, target, width) in groups.items()
        for kind in kinds
        for seed in seeds
    ]


def fit_and_predict(
    rows: DataFrame, networks: Sequence[Network], actual: str = "target_cluster_id", eligible: str = "training_eligible", steps: int = STEPS, patience: int = PATIENCE
) -> tuple[list[Fitted], DataFrame]:
    """All models fitted on eligible training rows, chosen on validation, and every row with ``predicted``, one class per model."""
    fitted = fit_networks(rows, networks, f"partition = 'train' and {eligible}", "partition = 'validation'", actual, steps, patience=patience)
    scored = predict_networks(rows, fitted)
    predicted = F.transform("probabilities", lambda p: F.when(p.isNotNull(), V.argmax(p)))
    return fitted, stage(scored.withColumn("predicted", predicted), "replicated")


def unfitted(rows: DataFrame) -> DataFrame:
    """What ``fit_and_predict`` scores where no model has training rows: nothing."""
    return rows.where(F.lit(False)).withColumn("predicted", F.lit(None).cast("array<int>"))


def paired_intervals(
    rows: DataFrame, models: dict[str, Sequence[int]], k: int, length: int, draws: int = DRAWS, seed: int = 7, baseline: str = "input_cluster_id", actual: str = "target_cluster_id", start_expr=None
) -> DataFrame:
    """For each kind of model: mean macro-F1 over its seeds minus the baseline's, with a block-bootstrap interval.

    ``rows`` are test rows with ``position`` 0..n-1 in time order; ``models`` gives the places in ``predicted`` of
    each kind's seeds. All kinds share the same draws, so their intervals are paired.
    """
    entries = [F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("place"), F.col("predicted")[p].alias("guess")) for kind, at in models.items() for p in at]
    rule = F.struct(F.lit("").alias("kind"), F.lit(-1).alias("place"), F.col(baseline).cast("int").alias("guess"))
    long = rows.select("position", F.col(actual).alias("actual"), F.inline(F.array(rule, *entries)))
    starts = BB.draw_starts(rows, length, draws, seed, start_expr)
    drawn = BB.bootstrap_scores(long, starts, length, k, ["kind", "place"], predicted="guess")
    means = drawn.groupBy("draw", "kind").agg(F.avg("macro_f1").alias("f1"))
    base = means.where("kind = ''").select("draw", F.col("f1").alias("base"))
    differences = means.where("kind <> ''").join(base, "draw").withColumn("difference", F.col("f1") - F.col("base"))
    return differences.groupBy("kind").agg(
        F.count(F.lit(1)).alias("draws"),
        F.percentile("difference", F.lit(0.025)).alias("ci_low"),
        F.percentile("difference", F.lit(0.975)).alias("ci_high"),
        F.avg((F.col("difference") > 0).cast("double")).alias("p_gt_0"),
    )


def scores(rows: DataFrame, models: dict[str, Sequence[int]], k: int, baseline: str = "input_cluster_id", actual: str = "target_cluster_id") -> DataFrame:
    """Per kind: number of seeds, mean and deviation of macro-F1 on validation and test, and what the test mean gains on the baseline."""
    kept = rows.where("partition in ('validation', 'test')")
    entries = [F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("place"), F.col("predicted")[p].alias("guess")) for kind, at in models.items() for p in at]
    long = kept.select("partition", F.col(actual).alias("actual"), F.inline(F.array(*entries)))
    f1 = MX.metrics(long, k, ["kind", "place", "partition"], "actual", "guess")
    rule = MX.metrics(kept.where("partition = 'test'"), k, [], actual, baseline).select("macro_f1").scalar()

    def of(partition: str) -> Column:
        return F.when(F.col("partition") == partition, F.col("macro_f1"))

    return f1.groupBy("kind").agg(
        F.count_distinct("place").alias("seeds"),
        F.avg(of("validation")).alias("validation_mean"),
        F.stddev_samp(of("validation")).alias("validation_sd"),
        F.avg(of("test")).alias("test_mean"),
        F.stddev_samp(of("test")).alias("test_sd"),
    ).withColumn("point", F.col("test_mean") - rule)


def compare_kinds(rows: DataFrame, networks: Sequence[Network], group: str, k: int, length: int, draws: int = DRAWS, start_expr=None) -> DataFrame:
    """``scores`` and ``paired_intervals`` of one group of models; ``rows`` carry ``predicted`` and the test rows' ``position``."""
    models: dict[str, list[int]] = {}
    for place, net in enumerate(networks):
        of, kind, _ = net.name.split("/")
        if of == group:
            models.setdefault(kind, []).append(place)
    made = scores(rows, models, k).join(paired_intervals(rows.where("partition = 'test'"), models, k, length, draws, start_expr=start_expr), "kind")
    return made.select(F.lit(group).alias("group"), "*", F.lit(length).cast("bigint").alias("block_rows"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
