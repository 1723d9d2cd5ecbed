"""Row predicates and coercing conversions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def number(col: Column) -> Column:
    """Numeric value, with unparseable text and NaN both as null."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def timestamp_utc(col: Column) -> Column:
    """UTC wall-clock timestamp of ISO text, whatever its offset; bad text gives null.

    Text without an offset is taken as UTC.
    """
    text = F.regexp_replace(col.cast("string"), r"(?i)\s*(z|utc)$", "")
    zone = F.regexp_extract(text, r"\d:\d{2}[\d:.]*\s*([+-]\d{2}:?\d{2})$", 1)
    local = F.when(zone == "", text).otherwise(F.regexp_replace(text, r"\s*[+-]\d{2}:?\d{2}$", ""))
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.right(zone, F.lit(2)).try_cast("int")
    ahead = F.when(zone == "", 0).when(zone.startswith("-"), -minutes).otherwise(minutes)
    return local.try_cast("timestamp_ntz") - F.make_dt_interval(mins=ahead)


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def ohlc_invalid(prices: tuple[str, ...] = PRICES) -> Column:
    """True for a null, non-positive or inconsistent candle."""
    o, h, l, c = (F.col(p) for p in prices)
    broken = (
        (h < F.greatest(o, l, c))
        | (l > F.least(o, h, c))
        | any_of([x <= 0 for x in (o, h, l, c)])
        | any_of([x.isNull() | F.isnan(x) for x in (o, h, l, c)])
    )
    return F.coalesce(broken, F.lit(True))


def not_finite(col: Column) -> Column:
    x = col.cast("double")
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def parsed_flag(col: Column) -> Column:
    """Boolean of ``true/false/1/0`` in any case; null for every other text."""
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)


def strict_flag(col: Column) -> Column:
    """As ``parsed_flag``, but other text stops the job."""
    flag = parsed_flag(col)
    return F.when(flag.isNotNull(), flag).otherwise(
        F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(col.cast("string"), F.lit("null")))).cast("boolean")
    )


def unix_path(col: Column) -> Column:
    return F.replace(col, F.lit("\\"), F.lit("/"))
