"""Chronological splits with purging and embargo."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeweave.functions.timing import id_block, moment
from regimeweave.operators.ordering import with_running_sums, with_tied_position
from regimeweave.operators.quality import GateError

Bounds = dict[str, tuple[datetime, datetime]]
BLOCK_SIZE = 1_000_000


def _literal(df: DataFrame, column: str, value: datetime) -> Column:
    return moment(value, df.schema[column].dataType)


def mark_fixed(
    pairs: DataFrame, bounds: Bounds, start: str = "input_start_time", stop: str = "target_stop_time", out: str = "partition"
) -> DataFrame:
    """Name the period that holds the whole pair (inclusive bounds); null where a boundary is crossed."""
    chain = F.lit(None).cast("string")
    for name, (lo, hi) in bounds.items():
        inside = (F.col(start) >= _literal(pairs, start, lo)) & (F.col(stop) <= _literal(pairs, stop, hi))
        chain = F.when(inside, F.lit(name)).otherwise(chain)
    return pairs.withColumn(out, chain)


def split_fixed(pairs: DataFrame, bounds: Bounds, **columns: str) -> DataFrame:
    """Pairs that lie inside one fixed period; the others are purged."""
    return mark_fixed(pairs, bounds, **columns).where(F.col(columns.get("out", "partition")).isNotNull())


def split_counts(marked: DataFrame, column: str = "partition") -> DataFrame:
    """Rows per partition, purged rows included."""
    return marked.groupBy(F.coalesce(F.col(column), F.lit("purged")).alias(column)).agg(F.count(F.lit(1)).alias("rows"))


def split_by_source(pairs: DataFrame, bounds: Bounds, source: str = "source_id") -> DataFrame:
    """Two isolated sources (``train_validation`` and ``test``): partition, or the reason for none."""
    start, stop = F.col("input_start_time"), F.col("target_stop_time")

    def inside(name: str) -> Column:
        lo, hi = bounds[name]
        return (start >= _literal(pairs, "input_start_time", lo)) & (stop <= _literal(pairs, "target_stop_time", hi))

    boundary = bounds["validation"][0]
    crosses = (start < _literal(pairs, "input_start_time", boundary)) & (stop >= _literal(pairs, "target_stop_time", boundary))
    history, future = F.col(source) == "train_validation", F.col(source) == "test"
    partition = (
        F.when(history & inside("train"), F.lit("train"))
        .when(history & inside("validation"), F.lit("validation"))
        .when(future & inside("test"), F.lit("test"))
    )
    reason = (
        F.when(history & crosses, F.lit("crosses_train_validation_boundary"))
        .when(history, F.lit("outside_fixed_train_or_validation_period"))
        .when(future, F.lit("future_target_outside_fixed_test_period"))
        .otherwise(F.concat(F.lit("unknown_source_id: "), F.coalesce(F.col(source), F.lit("null"))))
    )
    marked = pairs.withColumn("partition", partition)
    return marked.withColumn("reason", F.when(F.col("partition").isNull(), reason))


def _attach(df: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the facts of a row's source; without ``by`` there is one row of facts."""
    names = [c for c in facts.columns if c not in by]
    if by:
        return df.drop(*names).join(facts, [*by], "left")
    return df.withColumns({c: facts.select(c).scalar() for c in names})


def _values_at(df: DataFrame, value: str, positions: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One row per source: the value at given positions of its sorted rows; positions may use ``_total``.

    Copies of a value are counted before the running sum, so only distinct values are ordered.
    """
    counts = df.groupBy(*by, F.col(value).cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cumulated = with_running_sums(counts, by, ["_v"], id_block(F.col("_v"), BLOCK_SIZE), {"_to": F.col("_n")})
    held = _attach(cumulated, df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total")), by)
    picks = []
    for name, position in positions.items():
        here = (F.col("_to") - F.col("_n") <= position) & (position < F.col("_to"))
        picks.append(F.max(F.when(here, F.col("_v"))).alias(name))
    return held.groupBy(*by).agg(*picks)


def _bounded(position: Column, low: int | Column, high: Column) -> Column:
    low = F.lit(low) if isinstance(low, int) else low
    return F.least(F.greatest(F.floor(position).cast("bigint"), low), high)


def split_embargo2(
    windows: DataFrame,
    fraction: float = 0.90,
    embargo: int = 30,
    validation_start: int | None = None,
    start: str = "start_index",
    stop: str = "stop_index",
    by: Sequence[str] = (),
) -> DataFrame:
    """Train before ``validation start - embargo``, validation from there on, the rest purged.

    The validation start is a fixed index or the start of the row at position ``n * fraction``.
    Row indices of different sources are unrelated: name the source in ``by``, and each is split alone.
    A row with a null source is purged.
    """
    if embargo < 0:
        raise ValueError("embargo must not be negative")
    if validation_start is None:
        if not 0 < fraction < 1:
            raise ValueError("fraction must lie between 0 and 1")
        n = F.col("_total")
        marked = _attach(windows, _values_at(windows, start, {"validation_start_index": _bounded(n * fraction, 1, n - 1)}, by), by)
    else:
        marked = windows.withColumn("validation_start_index", F.lit(validation_start).cast("bigint"))
    v = F.col("validation_start_index")
    split = (
        F.when(F.col(stop) < v - embargo, F.lit("train"))
        .when(F.col(start) >= v, F.lit("validation"))
        .otherwise(F.lit("purged"))
    )
    return marked.withColumn("split", split)


def split_embargo3(
    pairs: DataFrame,
    fractions: Sequence[float] = (0.70, 0.15, 0.15),
    embargo: int = 0,
    start: str = "input_start_index",
    stop: str = "target_stop_index",
    by: Sequence[str] = (),
) -> DataFrame:
    """Three parts by fraction; train and validation are bound by their target's end.

    Each source of ``by`` is split alone; a row with a null source is purged.
    """
    if abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError("fractions must sum to 1")
    n = F.col("_total")
    first = _bounded(n * fractions[0], 1, n - 2)
    second = _bounded(n * (fractions[0] + fractions[1]), first + 1, n - 1)
    at = _values_at(pairs, start, {"v": first, "t": second}, by).select(*by, F.struct("v", "t").alias("_at"))
    held = _attach(pairs, at, by)
    v, t = F.col("_at.v"), F.col("_at.t")
    split = (
        F.when(F.col(stop) < v - embargo, F.lit("train"))
        .when((F.col(start) >= v) & (F.col(stop) < t - embargo), F.lit("validation"))
        .when(F.col(start) >= t, F.lit("test"))
        .otherwise(F.lit("purged"))
    )
    return held.withColumns({"validation_start_index": v, "test_start_index": t, "split": split}).drop("_at")


def split_purge_forward(
    windows: DataFrame,
    fraction: float = 0.10,
    purge: int = 30,
    order: Sequence[str] = ("start_index", "stop_index"),
    by: Sequence[str] = (),
) -> DataFrame:
    """The last ``round(n * fraction)`` rows are candidates; those that start within ``purge`` of training are purged.

    ``order`` must identify a row of its source and begin with an integer index. Each source of
    ``by`` is split alone; its columns must not be null.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    value, *tiebreak = order
    placed = with_tied_position(windows, by, value, tiebreak, id_block(F.col(value), BLOCK_SIZE), "_i")
    placed = _attach(placed, windows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    n = F.col("_n")
    candidates = F.least(F.greatest(F.bround(n * F.lit(fraction)).cast("bigint"), F.lit(1)), n - 1)
    placed = placed.withColumn("_cut", n - candidates)
    last_stop = placed.groupBy(*by).agg(F.max(F.when(F.col("_i") == F.col("_cut") - 1, F.col("stop_index"))).alias("_last"))
    held = _attach(placed, last_stop, by)
    split = (
        F.when(F.col("_i") < F.col("_cut"), F.lit("train"))
        .when(F.col("start_index") <= F.col("_last") + purge, F.lit("purged"))
        .otherwise(F.lit("validation"))
    )
    return held.withColumn("split", split).drop("_i", "_n", "_cut", "_last")


def require_parts(split: DataFrame, parts: Sequence[str], column: str = "split") -> DataFrame:
    """Stop when one of the named parts is empty."""
    found = {r[0] for r in split.where(F.col(column).isin(list(parts))).select(column).distinct().collect()}
    if set(parts) - found:
        raise GateError(f"empty split parts: {sorted(set(parts) - found)}")
    return split


def split_details(split: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per source: boundary, sizes and outermost indices of a two-way split."""
    def part(name):
        return F.col("split") == name

    return split.groupBy(*by).agg(
        F.max("validation_start_index").alias("validation_start_index"),
        F.max(F.when(part("train"), F.col("start_index"))).alias("train_last_start_index"),
        F.max(F.when(part("train"), F.col("stop_index"))).alias("train_last_stop_index"),
        F.min(F.when(part("validation"), F.col("start_index"))).alias("validation_first_start_index"),
        F.count_if(part("purged")).alias("purged_sample_count"),
    )
