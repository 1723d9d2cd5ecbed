"""Chronological splits and leakage audits."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from regimeweave.operators import audits, quality, reports, splits
from regimeweave.operators.skew import skew_join
from tests.helpers import START

HOUR = timedelta(hours=1)


def windows(spark, n, length=30):
    return spark.range(n).select(F.col("id").alias("start_index"), (F.col("id") + (length - 1)).alias("stop_index"))


def test_fixed_validation_start_with_embargo(spark):
    marked = splits.split_embargo2(windows(spark, 24_100), validation_start=24_047, embargo=30)
    row = splits.split_details(marked).first()
    assert (row.train_last_start_index, row.train_last_stop_index) == (23_987, 24_016)
    assert (row.validation_first_start_index, row.purged_sample_count) == (24_047, 59)


@pytest.mark.parametrize("n,fraction", [(100, 0.9), (7, 0.5), (3, 0.01), (1000, 0.123)])
def test_fraction_position(spark, n, fraction):
    row = splits.split_embargo2(windows(spark, n, 1), fraction=fraction, embargo=0).first()
    assert row.validation_start_index == min(max(int(n * fraction), 1), n - 1)


def test_three_way_split_never_overlaps(spark):
    pairs = windows(spark, 500, 60).withColumnsRenamed({"start_index": "input_start_index", "stop_index": "target_stop_index"})
    marked = splits.split_embargo3(pairs, (0.7, 0.15, 0.15), embargo=3)
    ends = {r.split: (r.a, r.z, r.n) for r in marked.groupBy("split").agg(F.min("input_start_index").alias("a"), F.max("target_stop_index").alias("z"), F.count("*").alias("n")).collect()}
    assert ends["train"][1] < ends["validation"][0] - 3 and ends["validation"][1] < ends["test"][0] - 3
    assert ends["validation"][0] == 350 and ends["test"][0] == 425
    with pytest.raises(ValueError):
        splits.split_embargo3(pairs, (0.7, 0.2, 0.2))
    with pytest.raises(quality.GateError):
        splits.require_parts(splits.split_embargo3(pairs.limit(3), embargo=500), ["train", "test"])


@pytest.mark.parametrize("n,expected", [(25, 2), (35, 4), (15, 2), (5, 1)])
def test_forward_purge_rounds_half_to_even(spark, n, expected):
    marked = splits.split_purge_forward(windows(spark, n, 1), 0.1, purge=0)
    assert marked.where("split <> 'train'").count() == expected


def test_forward_purge_depends_on_the_last_training_row(spark):
    marked = {r.start_index: r.split for r in splits.split_purge_forward(windows(spark, 1000), 0.2, purge=30).collect()}
    assert marked[799] == "train" and marked[800] == "purged" and marked[858] == "purged" and marked[859] == "validation"


@pytest.mark.parametrize("kind", ["embargo2", "embargo3", "purge"])
def test_each_source_is_split_alone(spark, kind):
    early, late = windows(spark, 800), windows(spark, 600).withColumns({c: F.col(c) + 50_000 for c in ("start_index", "stop_index")})
    both = early.withColumn("symbol", F.lit("A")).unionByName(late.withColumn("symbol", F.lit("B")))
    if kind == "embargo2":
        marked = splits.split_embargo2(both, by=["symbol"])
    elif kind == "embargo3":
        marked = splits.split_embargo3(both, embargo=3, start="start_index", stop="stop_index", by=["symbol"])
    else:
        marked = splits.split_purge_forward(both, 0.2, by=["symbol"])
    assert marked.count() == 1400
    for symbol in "AB":
        rows = marked.where(F.col("symbol") == symbol)
        last = rows.where("split = 'train'").agg(F.max("stop_index")).first()[0]
        first = rows.where("split = 'validation'").agg(F.min("start_index")).first()[0]
        assert last is not None and first is not None and last < first


def test_fixed_periods_are_inclusive(spark):
    rows = [(START, START + 5 * HOUR), (START, START + 6 * HOUR), (START + 6 * HOUR, START + 9 * HOUR)]
    df = spark.createDataFrame(rows, "input_start_time timestamp_ntz, target_stop_time timestamp_ntz")
    bounds = {"train": (START, START + 5 * HOUR), "test": (START + 6 * HOUR, START + 9 * HOUR)}
    got = [r.partition for r in splits.mark_fixed(df, bounds).orderBy("input_start_time", "target_stop_time").collect()]
    assert got == ["train", None, "test"]


PAIR = (
    "pair_id string, partition string, symbol string, input_symbol string, target_symbol string, input_start_index bigint, "
    "target_stop_index bigint, input_start_time timestamp_ntz, target_stop_time timestamp_ntz"
)


def boundary_frame(spark, test_source="B", test_index=0, test_start=20):
    rows = [
        ("a", "train", "A", "A", "A", 0, 9, START, START + 9 * HOUR),
        ("b", "validation", "A", "A", "A", 10, 19, START + 10 * HOUR, START + 19 * HOUR),
        ("c", "test", test_source, test_source, test_source, test_index, test_index + 9, START + test_start * HOUR, START + (test_start + 9) * HOUR),
    ]
    return spark.createDataFrame(rows, PAIR)


def test_index_may_restart_in_another_source(spark):
    rows = {r.boundary: r for r in audits.audit_boundaries(boundary_frame(spark)).collect()}
    assert all(r.passed for r in rows.values())
    assert rows["validation_to_test"].shared_sources == 0 and rows["validation_to_test"].gap_seconds == 3600.0
    assert rows["train_to_validation"].shared_sources == 1


def test_time_overlap_fails_even_across_sources(spark):
    rows = {r.boundary: r.passed for r in audits.audit_boundaries(boundary_frame(spark, test_start=19)).collect()}
    assert rows == {"train_to_validation": True, "validation_to_test": False}


def test_index_overlap_fails_inside_a_source(spark):
    rows = {r.boundary: r for r in audits.audit_boundaries(boundary_frame(spark, "A", 5)).collect()}
    assert rows["validation_to_test"].index_violations == 1 and not rows["validation_to_test"].passed


def test_findings_count_repeats_and_mixed_sources(spark):
    base = boundary_frame(spark)
    more = base.where("pair_id = 'a'").withColumn("partition", F.lit("test")).withColumn("target_symbol", F.lit("Z"))
    found = {r.partition: r for r in audits.partition_findings(base.unionByName(more).unionByName(base.where("pair_id = 'b'"))).collect()}
    assert found["test"].shared_ids == 1 and found["train"].shared_ids == 1 and found["test"].mixed_source_rows == 1
    assert found["validation"].repeated_ids == 1 and found["validation"].rows == 2


def test_shuffle_keeps_every_row_once(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("pair_id"), F.lit("train").alias("partition"))
    once, again = (sorted((r.pair_id, r.shuffled_rank) for r in reports.with_shuffle_rank(df, 7, buckets=16).collect()) for _ in range(2))
    assert once == again and sorted(rank for _, rank in once) == list(range(1000))
    assert once != sorted((r.pair_id, r.shuffled_rank) for r in reports.with_shuffle_rank(df, 8, buckets=16).collect())


def test_grid(spark):
    seen = spark.createDataFrame([(5, "mlp"), (10, "linear"), (7, "mlp")], "stride int, model string")
    found = sorted((r.stride, r.model, r.finding) for r in audits.grid_complete(seen, {"stride": [5, 10], "model": ["linear", "mlp"]}).collect())
    assert found == [(5, "linear", "missing"), (7, "mlp", "unexpected"), (10, "mlp", "missing")]


def test_one_content_held_by_most_rows(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("h"))
    assert reports.duplicate_groups(df, "h", "id").collect()[0].members == 2000
    assert reports.duplicate_members(df, "h", "id").count() == 2000
    row = reports.duplicate_summary(df, "h", "id").first()
    assert (row.row_count, row.unique_hash_count, row.duplicate_group_count) == (3000, 1001, 1)


def test_skew_join_equals_a_plain_join(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("3", 2), ("9", 3), ("none", 4)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(map(str, left.join(right, "k", how).select("id", "k").collect()))
        assert sorted(map(str, skew_join(left, right, "k", how, hot_keys=2).select("id", "k").collect())) == plain


def test_rank_with_many_rows_per_time(spark):
    df = spark.range(300).select(
        F.format_string("%03d", "id").alias("pair_id"), F.lit("train").alias("partition"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(hours=F.floor(F.col("id") / 100).cast("int"))).alias("input_start_time"),
    )
    rows = reports.with_rank(df, block=HOUR).collect()
    assert all(int(r.pair_id) == r.chronological_rank for r in rows)


def test_span_rules(spark):
    schema = (
        "partition string, chronological_rank bigint, input_start_index bigint, input_stop_index bigint, target_start_index bigint, "
        "target_stop_index bigint, target_cluster_id int, input_image string, target_image string"
    )
    rows = [
        ("train", 0, 0, 2, 3, 4, 0, "a", "b"), ("train", 1, 5, 7, 9, 10, 1, "c", "c"), ("train", 2, 4, 6, 7, 8, 7, "d", "e"),
        ("validation", 0, 10, 12, 13, 14, 0, "f", "g"),
    ]
    found = audits.audit_spans(spark.createDataFrame(rows, schema), 3, 2, [0, 1]).where("violations > 0").collect()
    assert {(r.partition, r.rule): r.violations for r in found} == {
        ("train", "overlap_or_gap"): 1, ("train", "label_outside_range"): 1, ("train", "not_chronological"): 1,
        ("train", "input_equals_target"): 1, ("validation", "overlaps_previous_partition"): 1,
    }
