"""Time arithmetic that works the same for TIMESTAMP and TIMESTAMP_NTZ columns."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def seconds(every: timedelta) -> int:
    if every <= timedelta(0) or every.microseconds:
        raise ValueError("a step must be a whole number of seconds")
    return int(every.total_seconds())


def interval(every: timedelta, times: int = 1) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {seconds(every) * times})")


def time_block(time: Column, width: timedelta) -> Column:
    """Start of the fixed-width block that holds ``time``: a coarse, order-preserving key.

    ``window`` alone would drop rows without a time; here such a row stops the job.
    """
    stop = F.raise_error(F.lit("a row without a time has no place in time order"))
    return F.window(F.coalesce(time, stop), f"{seconds(width)} seconds").start


def packed_order(time: Column, number: Column) -> Column:
    """``(time, number)`` as one 38-digit decimal of the same order, which hash aggregates can hold; ``number`` is a bigint."""
    micros = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), time).cast("decimal(18,0)")
    # a bigint moved above zero stays below the step of a microsecond
    shifted = number.cast("decimal(19,0)") + F.lit(Decimal(2**63))
    return (micros * F.lit(Decimal(2 * 10**19)) + shifted).cast("decimal(38,0)")


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    gap = later - earlier
    return (
        F.date_part(F.lit("DAY"), gap) * 86400
        + F.date_part(F.lit("HOUR"), gap) * 3600
        + F.date_part(F.lit("MINUTE"), gap) * 60
        + F.date_part(F.lit("SECOND"), gap).cast("double")
    ).cast("double")


def id_block(number: Column, size: int) -> Column:
    """Block number of an integer key; at most ``size`` distinct keys share a block."""
    return F.floor(number / F.lit(size)).cast("bigint")


def moment(value: datetime, kind: DataType | str = "timestamp_ntz") -> Column:
    """Literal of a naive wall-clock time, independent of the Python and the JVM time zone."""
    return F.lit(value.isoformat(sep=" ")).cast(kind)
