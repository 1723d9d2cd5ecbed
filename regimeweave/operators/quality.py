"""Row-level gates: coercion, duplicates, periods, domains, renames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from regimeweave.functions.predicates import any_of, not_finite, number, ohlc_invalid, timestamp_utc, unix_path
from regimeweave.functions.timing import elapsed_seconds, moment, time_block
from regimeweave.operators.gaps import BLOCK_WIDTH
from regimeweave.operators.ordering import with_position


class GateError(ValueError):
    """Rows broke a rule that the following step relies on."""


def coerce(df: DataFrame, times: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """Parse text columns; a value that cannot be parsed becomes null."""
    return df.withColumns(
        {**{c: timestamp_utc(F.col(c)) for c in times}, **{c: number(F.col(c)) for c in numbers}}
    )


def examples(df: DataFrame, predicate: Column, ids: Sequence[str], limit: int = 10) -> DataFrame:
    """The first violating ids in id order (a distributed top-k)."""
    return df.where(predicate).select(*ids).orderBy(*ids).limit(limit)


def require_none(df: DataFrame, predicate: Column, ids: Sequence[str], message: str) -> DataFrame:
    """Return ``df`` unchanged, or stop with the number of violating rows and ten of their ids."""
    found = df.where(predicate).count()
    if found:
        sample = [tuple(row) for row in examples(df, predicate, ids).collect()]
        raise GateError(f"{message}: {found} rows, e.g. {sample}")
    return df


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with the number of rows that break it, in a single pass."""
    counted = df.agg(*[F.count_if(F.coalesce(p, F.lit(True))).alias(name) for name, p in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def drop_invalid(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Observation]:
    """Drop rows with a null in ``columns``; the observation reports ``dropped`` after an action."""
    seen = Observation()
    watched = df.observe(seen, F.count_if(any_of([F.col(c).isNull() for c in columns])).alias("dropped"))
    return watched.na.drop(subset=list(columns)), seen


def dedupe_first(df: DataFrame, key: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """Keep the first row of each key. Copies merge before the shuffle, however many there are."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(
        F.min_by(whole, F.struct(*tiebreak)).alias("_row")
    )
    return first.select("_row.*")


def duplicated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, key: Sequence[str], message: str = "duplicate keys") -> DataFrame:
    require_none(duplicated_keys(df, key), F.lit(True), key, message)
    return df


def require_domain(df: DataFrame, column: str, values: Iterable, ids: Sequence[str]) -> DataFrame:
    allowed = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return require_none(df, ~allowed, ids, f"{column} outside its domain")


def require_finite(df: DataFrame, columns: Sequence[str], ids: Sequence[str]) -> DataFrame:
    return require_none(df, any_of([not_finite(F.col(c)) for c in columns]), ids, "non-finite values")


def require_valid_ohlc(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return require_none(df, ohlc_invalid(), ids, "invalid OHLC rows")


def with_row_index(
    df: DataFrame,
    by: Sequence[str] = ("symbol",),
    time: str = "open_time",
    out: str = "row_index",
    block: timedelta = BLOCK_WIDTH,
) -> DataFrame:
    """Dense 0-based index in time order."""
    return with_position(df, by, [time], time_block(F.col(time), block), out)


def period_ends(df: DataFrame, lo: datetime, hi: datetime, by: Sequence[str] = ("symbol",), time: str = "open_time") -> DataFrame:
    """Per symbol: do the first and the last candle of the period exist."""
    return df.groupBy(*by).agg(
        F.bool_or(F.col(time) == moment(lo, df.schema[time].dataType)).alias("has_start"),
        F.bool_or(F.col(time) == moment(hi, df.schema[time].dataType)).alias("has_end"),
    )


def slice_period(
    df: DataFrame, lo: datetime, hi: datetime, by: Sequence[str] = ("symbol",), time: str = "open_time", check: bool = True
) -> DataFrame:
    """Rows of an inclusive period, re-indexed from 0; both end candles must exist."""
    if check:
        require_none(period_ends(df, lo, hi, by, time), ~(F.col("has_start") & F.col("has_end")), by, "period end candle missing")
    kind = df.schema[time].dataType
    inside = df.where(F.col(time).between(moment(lo, kind), moment(hi, kind)))
    return with_row_index(inside, by, time, "period_index")


def check_boundary(
    first: DataFrame,
    second: DataFrame,
    expected: dict[str, datetime],
    every: timedelta,
    inner: Sequence[datetime] = (),
    time: str = "open_time",
) -> DataFrame:
    """One report row on two candle sources that must follow each other without overlap.

    ``expected`` holds ``first_start``, ``first_end``, ``second_start`` and ``second_end``;
    ``inner`` lists candles that must exist in the first source.
    """
    kind = first.schema[time].dataType
    tagged = first.select(F.col(time).alias("t"), F.lit(True).alias("in_first")).unionByName(
        second.select(F.col(time).alias("t"), F.lit(False).alias("in_first"))
    )
    stamps = tagged.groupBy("t").agg(F.bool_or("in_first").alias("a"), F.bool_or(~F.col("in_first")).alias("b"))
    facts = stamps.agg(
        F.min(F.when(F.col("a"), F.col("t"))).alias("first_start"),
        F.max(F.when(F.col("a"), F.col("t"))).alias("first_end"),
        F.min(F.when(F.col("b"), F.col("t"))).alias("second_start"),
        F.max(F.when(F.col("b"), F.col("t"))).alias("second_end"),
        F.count_if(F.col("a") & F.col("b")).alias("overlapping_timestamps"),
        F.count_if(F.col("a") & F.col("t").isin([moment(x, kind) for x in inner]) if inner else F.lit(False)).alias("_inner"),
    )
    ends = [(F.col(k) == moment(v, kind)).alias(f"{k}_ok") for k, v in expected.items()]
    gap = elapsed_seconds(F.col("second_start"), F.col("first_end"))
    report = facts.select("*", *ends, gap.alias("gap_seconds"), (F.lit(len(inner)) - F.col("_inner")).alias("inner_missing"))
    passed = (
        (F.col("overlapping_timestamps") == 0)
        & (F.col("gap_seconds") == every.total_seconds())
        & (F.col("inner_missing") == 0)
    )
    for k in expected:
        passed = passed & F.col(f"{k}_ok")
    return report.withColumn("passed", F.coalesce(passed, F.lit(False))).drop("_inner")


def prefixed(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in columns])


def canonicalize(df: DataFrame, canonical: str = "input_image", generated: str = "input_image_path") -> DataFrame:
    """One path column under its canonical name; two columns must agree up to the slash style."""
    if canonical not in df.columns:
        if generated not in df.columns:
            raise GateError(f"neither {canonical} nor {generated} exists")
        return df.withColumnRenamed(generated, canonical)
    if generated in df.columns:
        same = unix_path(F.col(canonical)).eqNullSafe(unix_path(F.col(generated)))
        require_none(df, ~same, [canonical, generated], "conflicting path columns")
    return df
