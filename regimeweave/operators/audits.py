"""Leakage and schema audits of split manifests; every audit returns a table of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regimeweave.functions.predicates import unix_path
from regimeweave.functions.timing import elapsed_seconds, id_block
from regimeweave.operators.ordering import with_previous

ORDER = ("train", "validation", "test")


def _rank(partitions: Sequence[str]):
    return F.array_position(F.array(*[F.lit(p) for p in partitions]), F.col("partition"))


def partition_findings(pairs: DataFrame, by: str = "symbol", partitions: Sequence[str] = ORDER) -> DataFrame:
    """Per partition: repeated ids, ids shared with another partition, mixed sources, targets before inputs."""
    ids = pairs.groupBy("pair_id", "partition").agg(F.count(F.lit(1)).alias("_n"))
    spread = ids.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_parts"), F.map_from_entries(F.collect_list(F.struct("partition", "_n"))).alias("_m"))
    repeated = spread.select("_parts", F.explode("_m").alias("partition", "_n")).groupBy("partition").agg(
        F.count_if(F.col("_n") > 1).alias("repeated_ids"), F.count_if(F.col("_parts") > 1).alias("shared_ids")
    )
    backwards = F.coalesce(F.col("target_stop_time") <= F.col("input_start_time"), F.lit(True))
    mixed = F.col(f"input_{by}") != F.col(f"target_{by}") if f"input_{by}" in pairs.columns else F.lit(False)
    rows = pairs.groupBy("partition").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(mixed).alias("mixed_source_rows"),
        F.count_if(backwards).alias("backward_rows"),
        F.min("input_start_time").alias("first_input_time"),
        F.max("target_stop_time").alias("last_target_time"),
    )
    return rows.join(repeated, "partition").where(_rank(partitions) > 0)


def audit_boundaries(
    pairs: DataFrame, source: str = "symbol", partitions: Sequence[str] = ORDER
) -> DataFrame:
    """One row per neighbouring pair of partitions: time gap and, for sources in both, index order.

    Row indices of different sources are unrelated, so they are compared inside a source only.
    """
    ends = pairs.groupBy("partition").agg(
        F.min("input_start_time").alias("first"), F.max("target_stop_time").alias("last")
    )
    ranked = ends.withColumn("_r", _rank(partitions)).where("_r > 0")
    neighbour = Window.orderBy("_r")  # one row per partition
    boundaries = ranked.select(
        "_r",
        F.col("partition").alias("left_partition"),
        F.lead("partition").over(neighbour).alias("right_partition"),
        F.col("last").alias("left_target_end"),
        F.lead("first").over(neighbour).alias("right_input_start"),
    ).where("right_partition is not null")
    per_source = pairs.groupBy(source, "partition").agg(
        F.max("target_stop_index").alias("_stop"), F.min("input_start_index").alias("_start")
    ).withColumn("_r", _rank(partitions))
    left = per_source.select(source, "_r", "_stop")
    right = per_source.select(source, (F.col("_r") - 1).alias("_r"), "_start")
    shared = left.join(right, [source, "_r"]).groupBy("_r").agg(
        F.count(F.lit(1)).alias("_shared"), F.count_if(F.col("_stop") >= F.col("_start")).alias("_late")
    )
    zero = F.lit(0).cast("bigint")
    report = boundaries.join(shared, "_r", "left").select(
        F.concat_ws("_to_", "left_partition", "right_partition").alias("boundary"),
        "left_target_end",
        "right_input_start",
        elapsed_seconds(F.col("right_input_start"), F.col("left_target_end")).alias("gap_seconds"),
        F.coalesce("_shared", zero).alias("shared_sources"),
        F.coalesce("_late", zero).alias("index_violations"),
    )
    return report.withColumn("passed", (F.col("gap_seconds") > 0) & (F.col("index_violations") == 0))


def index_boundaries(pairs: DataFrame, partitions: Sequence[str] = ORDER, by: Sequence[str] = ()) -> DataFrame:
    """Per source and partition: index range, and whether it begins after the source's previous partition's last target."""
    ends = pairs.groupBy(*by, "partition").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("input_start_index").alias("first_input_index"),
        F.max("target_stop_index").alias("last_target_index"),
    )
    before = Window.partitionBy(*by).orderBy(_rank(partitions))  # one row per partition
    previous = F.lag("last_target_index").over(before)
    return ends.where(_rank(partitions) > 0).withColumn(
        "separated", F.coalesce(F.col("first_input_index") > previous, F.lit(True))
    )


def audit_spans(
    pairs: DataFrame,
    n_in: int,
    n_out: int,
    classes: Sequence[int],
    partitions: Sequence[str] = ORDER,
    rank: str = "chronological_rank",
    block_size: int = 1_000_000,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per partition and rule with the number of violations; all rules in one aggregation.

    Order and overlap are judged inside a source (``by``, not null); each overlapping source counts once.
    """
    followed = with_previous(
        pairs, [*by, "partition"], [rank], id_block(F.col(rank), block_size), "input_start_index", "_previous"
    )
    label = F.col("target_cluster_id").isin(list(classes))
    rules = {
        "wrong_input_length": F.col("input_stop_index") - F.col("input_start_index") + 1 != n_in,
        "wrong_target_length": F.col("target_stop_index") - F.col("target_start_index") + 1 != n_out,
        "overlap_or_gap": F.col("target_start_index") != F.col("input_stop_index") + 1,
        "label_outside_range": ~F.coalesce(label, F.lit(False)),
        "not_chronological": F.col("input_start_index") < F.col("_previous"),
    }
    if {"input_image", "target_image"} <= set(pairs.columns):
        # the target must never be its own predictor
        rules["input_equals_target"] = unix_path(F.col("input_image")) == unix_path(F.col("target_image"))
    counted = followed.groupBy(*by, "partition").agg(
        F.min("input_start_index").alias("_first"),
        F.max("target_stop_index").alias("_last"),
        *[F.count_if(p).alias(name) for name, p in rules.items()],
    )
    before = Window.partitionBy(*by).orderBy(_rank(partitions))  # one row per partition
    overlap = F.coalesce(F.col("_first") <= F.lag("_last").over(before), F.lit(False)).cast("bigint")
    marked = counted.withColumn("overlaps_previous_partition", overlap)
    checked = marked.groupBy("partition").agg(*[F.sum(name).alias(name) for name in [*rules, "overlaps_previous_partition"]])
    return checked.unpivot(["partition"], [*rules, "overlaps_previous_partition"], "rule", "violations")


def grid_complete(observed: DataFrame, axes: dict[str, Sequence]) -> DataFrame:
    """Cells of the full grid that are missing from ``observed``, and observed cells outside the grid."""
    grid = observed.sparkSession.range(1).select()
    for name, values in axes.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    names = list(axes)
    seen = observed.select(*names).distinct()
    missing = grid.join(seen, names, "left_anti").withColumn("finding", F.lit("missing"))
    extra = seen.join(grid, names, "left_anti").withColumn("finding", F.lit("unexpected"))
    return missing.unionByName(extra)


def verify_ledger(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded against present content hash per path: ``match``, ``changed`` or ``absent``."""
    present = files.select("path", F.col("sha256").alias("present_sha256"))
    state = (
        F.when(F.col("present_sha256").isNull(), F.lit("absent"))
        .when(F.col("present_sha256") == F.col("sha256"), F.lit("match"))
        .otherwise(F.lit("changed"))
    )
    return ledger.join(present, "path", "left").withColumn("state", state)
