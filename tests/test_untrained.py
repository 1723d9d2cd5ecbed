"""Queries on tables whose pairs leave no training row: the rows of their check statements, no error."""

from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from regimeweave.operators import metrics as MX
from regimeweave.operators import soft_targets as T
from regimeweave.sources import manifests as M
from tests.helpers import sorted_rows

EMPTY = [
    "A4_A5_manifest_roundtrip", "F2_temperature", "F8_soft_class_weights", "F9_class_weights", "F11_uncertainty", "F13_check_weights",
    "G9_accepted_weights", "I8_soft_loss", "I11_logistic", "I16_diff_summary", "I23_stride_weights",
]
LATE = ["F4_F5_memberships", "F10_mass_report", "I17_certainty_strata"]


def events(spark, folder, start, hours, skip):
    """Three events an hour; every ``skip``-th hour holds a zero, so its bar is not valid."""
    rows = [
        (h * 3 + i, start + timedelta(hours=h, minutes=20 * i), "view", 0.0 if h % skip == 0 and i == 1 else 1.0 + (h * 7 + i * 5) % 11)
        for h in range(hours)
        for i in range(3)
    ]
    path = str(folder / "events.parquet")
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(path)
    return str(folder)


@pytest.fixture(scope="module")
def gaps(spark, tmp_path_factory):
    return events(spark, tmp_path_factory.mktemp("gaps"), datetime(2024, 1, 1), 720, 40)


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    return events(spark, tmp_path_factory.mktemp("late"), datetime(2024, 1, 21), 100, 1000)


def compare(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    got = entry.queries()[name](spark, folder)
    assert sorted(names) == sorted(got.columns)
    assert sorted_rows(got.collect(), got.columns) == sorted_rows(result.fetchall(), names)


@pytest.mark.parametrize("name", EMPTY)
def test_no_pairs_at_all(spark, gaps, name):
    compare(spark, gaps, name)


@pytest.mark.parametrize("name", LATE)
def test_pairs_but_none_to_train_on(spark, late, name):
    compare(spark, late, name)


@pytest.mark.parametrize("name", ["I10_soft_logistic_gain", "I23_stride_models", "I24_numeric_controls"])
def test_nothing_is_claimed_of_a_model_without_training_rows(spark, gaps, name):
    rows = entry.queries()[name](spark, gaps).collect()
    assert [r.beats_prior for r in rows] == [None] if name == "I10_soft_logistic_gain" else rows == []


def test_unfitted_models_keep_their_samples(spark, late):
    rows = entry.queries()["I11_logistic"](spark, late).collect()
    assert rows and all(r.samples > 0 and r.probabilities_ok is None and r.class_mass_met is None for r in rows)


def test_gates_still_stop_unless_told_otherwise(spark, tmp_path):
    none = spark.createDataFrame([], "target_distances array<double>, target_soft array<double>, target_cluster_id int")
    for gate in (T.temperature(none), T.soft_class_weights(none, range(3)), T.class_weights(none, range(3))):
        with pytest.raises(Exception, match="training"):
            gate.collect()
    with pytest.raises(ValueError):
        T.temperature(none, on_none="skip")
    pairs = spark.createDataFrame([], "pair_id string, chronological_rank bigint, partition string")
    M.write_manifests(pairs, str(tmp_path / "m"))
    with pytest.raises(Exception):
        M.read_manifest(spark, str(tmp_path / "m"), M.Contract(pairs.schema))
    assert M.read_manifest(spark, str(tmp_path / "m"), M.Contract(pairs.schema, empty=True)).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        M.read_manifest(spark, str(tmp_path / "none"), M.Contract(pairs.schema, empty=True))


def test_absent_class_has_no_weight_row(spark):
    rows = spark.createDataFrame([(0,), (0,), (2,)], "target_cluster_id int")
    got = {r["cluster_id"]: r["class_weight"] for r in T.class_weights(rows, range(3), on_zero="drop").collect()}
    assert got == {0: 0.5, 2: 1.0}


def test_summary_of_no_common_rows(spark):
    frame = spark.createDataFrame([], "pair_id string, actual_target_cluster_id int, predicted_target_cluster_id int")
    row = MX.diff_summary(frame, frame, 3).first()
    assert row.rows == 0 and row.targets_identical and row.changed_percentage != row.changed_percentage
