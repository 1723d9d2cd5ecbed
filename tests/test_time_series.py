"""Gaps, runs, windows and row numbers against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from regimeweave.functions.timing import id_block
from regimeweave.operators import gaps, ordering, quality
from regimeweave.operators import windows as W
from tests.helpers import START, candles

HOUR = timedelta(hours=1)
DAY = timedelta(days=1)


def brute_starts(offsets, n):
    return [
        i
        for i in range(len(offsets) - n + 1)
        if all(offsets[j + 1] - offsets[j] == 1 for j in range(i, i + n - 1))
    ]


@pytest.fixture(scope="module")
def ragged():
    rng = random.Random(5)
    hours = [h for h in range(400) if rng.random() > 0.06]
    return sorted(hours + [50.5, 51.25])


@pytest.mark.parametrize("block", [DAY, timedelta(days=3), timedelta(days=900)])
def test_valid_starts_do_not_depend_on_the_block(spark, ragged, block):
    runs = gaps.with_runs(candles(spark, ragged), block=block)
    got = sorted(r.start_index for r in W.valid_starts(runs, 6).collect())
    assert got == brute_starts(ragged, 6)


def test_half_hour_rows_break_a_window_of_the_right_length(spark):
    # the last candle is n - 1 hours after the first, but the steps are 0.5 h and 1.5 h
    runs = gaps.with_runs(candles(spark, [0, 1, 1.5, 3]))
    assert W.valid_starts(runs, 4).count() == 0
    assert [r.start_index for r in W.valid_starts(runs, 2).collect()] == [0]


def test_skips_name_the_first_gap(spark):
    runs = gaps.with_runs(candles(spark, [0, 1, 2, 5, 6, 9, 10]), block=DAY)
    first = W.skipped_windows(runs, 5).orderBy("start_index").first()
    assert first.gap_after_time == START + 2 * HOUR and first.next_time == START + 5 * HOUR
    assert first.stop_time == START + 6 * HOUR and first.stop_index == 4


def test_gap_far_longer_than_a_block(spark):
    runs = gaps.with_runs(candles(spark, [0, 1, 500, 501]), block=DAY)
    events = gaps.gap_events(runs).collect()
    assert [(e.row_index, e.gap_seconds) for e in events] == [(2, 499 * 3600.0)]
    assert gaps.missing_slots(candles(spark, [0, 1, 500, 501]), block=DAY).count() == 498


def test_audit_counts_follow_the_identities(spark):
    offsets = [h for h in range(200) if h not in (40, 41, 100)]
    row = gaps.audit_candles(candles(spark, offsets), 30, block=timedelta(days=2)).first()
    assert (row.rows, row.candidate_windows, row.gap_event_count, row.missing_slot_count) == (197, 168, 2, 3)
    # every gap event rules out n - 1 starts
    assert row.skipped_windows == 2 * 29 and row.valid_windows == 168 - 58


def test_audit_with_copies_matches_row_based_counting(spark):
    offsets = [0, 1, 2, 2, 3, 4, 5, 6, 6, 6, 7, 8, 10]
    row = gaps.audit_candles(candles(spark, offsets), 3).first()
    assert row.rows == 13 and row.duplicate_timestamps == 3
    assert row.valid_windows == len(brute_starts(offsets, 3))
    assert row.gap_event_count == sum(b - a != 1 for a, b in zip(offsets, offsets[1:]))


def test_audit_sees_bad_rows(spark):
    bad = candles(spark, range(40)).withColumn("high", F.when(F.hour("open_time") == 3, F.lit(0.5)).otherwise(F.col("high")))
    bad = bad.withColumn("open_time", F.when(F.hour("open_time") != 5, F.col("open_time")))
    row = gaps.audit_candles(bad, 3).first()
    assert row.invalid_ohlc_rows == 2 and row.timestamps_unparseable == 2 and row.rows == 40


def test_window_arrays_cross_block_borders(spark, ragged):
    base = gaps.with_runs(candles(spark, ragged, price=lambda i: float(i)), block=DAY)
    rows = W.window_arrays(base, 6, block=DAY).collect()
    assert sorted(r.start_index for r in rows) == brute_starts(ragged, 6)
    assert all(r.opens == [float(r.start_index + j) for j in range(6)] for r in rows)


def test_scale_features_do_not_depend_on_the_block(spark, ragged):
    base = candles(spark, ragged, price=lambda i: 100.0 + (i * 37) % 11)
    small, large = (
        {r.start_index: tuple(round(x, 9) for x in r[3:]) for r in W.scale_features(gaps.with_runs(base), 6, block=b).collect()}
        for b in (DAY, timedelta(days=900))
    )
    assert small == large and len(small) == len(brute_starts(ragged, 6))


def test_window_longer_than_a_block_is_refused(spark):
    with pytest.raises(ValueError):
        W.window_arrays(gaps.with_runs(candles(spark, range(5))), 60, block=DAY)


def test_spans_list_the_tail_on_request(spark):
    runs = gaps.with_runs(candles(spark, range(10)))
    assert W.build_spans(runs, 4, 3).count() == 4
    assert W.skipped_spans(runs, 4, 3).count() == 0
    assert W.skipped_spans(runs, 4, 3, with_tail=True).count() == 6


def test_positions_and_running_sums(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 500)
    rows = [("hot" if i % 3 else "cold", v, v % 5) for i, v in enumerate(ids)]
    df = spark.createDataFrame(rows, "g string, v bigint, x bigint")
    placed = ordering.with_position(df, ["g"], ["v"], id_block(F.col("v"), 97), "i", "n")
    summed = ordering.with_running_sums(placed, ["g"], ["v"], id_block(F.col("v"), 97), {"s": F.col("x")})
    for group in ("hot", "cold"):
        expected, total = [], 0
        members = sorted((v, x) for g, v, x in rows if g == group)
        for i, (v, x) in enumerate(members):
            total += x
            expected.append((v, i, len(members), total))
        got = sorted((r.v, r.i, r.n, r.s) for r in summed.where(F.col("g") == group).collect())
        assert got == expected


def test_contiguous_ranges(spark):
    df = spark.createDataFrame([(x,) for x in [7, 3, 4, 5, 9, 10, 3]], "v bigint")
    got = sorted((r.first, r["last"], r["count"]) for r in ordering.contiguous_ranges(df, "v", size=2).collect())
    assert got == [(3, 5, 3), (7, 7, 1), (9, 10, 2)]


def test_monotonic_across_blocks(spark):
    df = spark.createDataFrame([(i, i if i != 50 else 10) for i in range(100)], "i bigint, t bigint")
    row = ordering.is_monotonic(df, ["i"], id_block(F.col("i"), 10), "t").first()
    assert (row.rows, row.monotonic, row.falls) == (100, False, 1)


def test_period_slice_needs_its_end_candles(spark):
    df = candles(spark, range(48))
    lo, hi = START + 2 * HOUR, START + 9 * HOUR
    assert [r.period_index for r in quality.slice_period(df, lo, hi).orderBy("open_time").collect()] == list(range(8))
    with pytest.raises(quality.GateError):
        quality.slice_period(df, lo, datetime(2025, 1, 1))


def test_boundary_report_finds_overlap(spark):
    a, b = candles(spark, range(10)), candles(spark, range(9, 20))
    expected = {
        "first_start": START, "first_end": START + 9 * HOUR, "second_start": START + 10 * HOUR, "second_end": START + 19 * HOUR,
    }
    row = quality.check_boundary(a, b, expected, HOUR).first()
    assert row.overlapping_timestamps == 1 and not row.passed and not row.second_start_ok
    good = quality.check_boundary(a, candles(spark, range(10, 20)), expected, HOUR, [START + 4 * HOUR]).first()
    assert good.passed and good.gap_seconds == 3600.0


def test_candle_geometry_of_a_flat_candle(spark):
    flat = candles(spark, range(3)).withColumn("close", F.col("open"))
    row = W.candle_geometry(flat).first()
    assert row.rising and row.body_low == row.body_high
    padded = W.padded_geometry(W.window_arrays(gaps.with_runs(flat), 3)).first()
    assert padded.body_high > padded.body_low
