"""Candle files: exchange pages, CSV files with varying headers, several sources at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimeweave.functions.predicates import PRICES, number, timestamp_utc
from regimeweave.operators.quality import GateError, dedupe_first

# accepted header names of the timestamp column, in order of preference
TIME_ALIASES = ("open_time", "timestamp", "datetime", "date", "time")


def read_kline_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of positional rows, one JSON array of arrays per line; the first copy of a time stays.

    Only five of the twelve fields are kept. Field 0 is the open time in milliseconds. A line
    that is no such array stops the job; blank lines are skipped.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    parsed = F.from_json("value", "array<array<string>>")
    stop = F.raise_error(F.concat(F.lit("unreadable page in "), F.col("_file")))
    pages = text.where("trim(value) != ''").select("_file", F.coalesce(parsed, stop).alias("page"))
    # the order of pages inside a file is the order of their first candle
    rows = pages.select(
        "_file",
        F.try_element_at(F.col("page")[0], F.lit(1)).try_cast("bigint").alias("_page"),
        F.posexplode("page").alias("_row", "f"),
    )
    millis = F.try_element_at("f", F.lit(1)).try_cast("bigint")
    since_epoch = F.make_dt_interval(secs=(millis / 1000).cast("decimal(18,6)"))
    stamped = rows.select(
        "_file",
        "_page",
        "_row",
        (F.expr("timestamp_ntz'1970-01-01 00:00:00'") + since_epoch).alias("open_time"),
        *[number(F.try_element_at("f", F.lit(i + 2))).alias(p) for i, p in enumerate(PRICES)],
    )
    return dedupe_first(stamped, ["open_time"], ["_file", "_page", "_row"]).select("open_time", *PRICES)


def resolve_columns(
    available: Sequence[str], columns: dict[str, str] | None = None, aliases: Sequence[str] = TIME_ALIASES
) -> dict[str, str]:
    """Actual header per canonical name; a configured name comes before the aliases, case is ignored."""
    lookup = {c.strip().lower(): c for c in available}
    found = {}
    for name in ("open_time", *PRICES):
        known = list(aliases) if name == "open_time" else [name]
        wanted = [columns[name], *known] if columns and name in columns else known
        match = next((lookup[w.strip().lower()] for w in wanted if w.strip().lower() in lookup), None)
        if match is None:
            raise GateError(f"no column for {name}: expected one of {wanted}, found {list(available)}")
        found[name] = match
    return found


def header_census(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line of every CSV file below ``path``, and the files that have it: one entry per layout."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    # lines of a split are numbered in their order
    numbered = lines.where("at = 0").withColumn("line", F.monotonically_increasing_id())
    first = numbered.groupBy("file").agg(F.min_by("value", "line").alias("header"))
    return {r.header: r.files for r in first.groupBy("header").agg(F.sort_array(F.collect_set("file")).alias("files")).collect()}


def read_ohlc(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """CSV candles under canonical names; unparseable cells become null.

    Files may differ in the names, order and number of their columns: each layout is read on its own and all meet under the canonical
    names. A layout that lacks one of them stops before anything is read.
    """
    parts = []
    for _, files in sorted(header_census(spark, path).items()):
        raw = spark.read.option("header", True).option("inferSchema", False).csv(files)
        found = resolve_columns(raw.columns, columns)
        parts.append(
            raw.select(
                timestamp_utc(F.col(f"`{found['open_time']}`")).alias("open_time"),
                *[number(F.col(f"`{found[p]}`")).alias(p) for p in PRICES],
            )
        )
    if not parts:
        raise GateError(f"no CSV lines below {path}")
    return reduce(DataFrame.unionByName, parts)


def union_sources(sources: dict[str, DataFrame], merge: bool = False) -> DataFrame:
    """Several candle tables in one, tagged with ``source_id``.

    With ``merge`` they form one series in the order given: the first source that has a time wins.
    """
    tagged = [
        df.withColumn("source_id", F.lit(name)).withColumn("_rank", F.lit(i))
        for i, (name, df) in enumerate(sources.items())
    ]
    rows = reduce(DataFrame.unionByName, tagged)
    if not merge:
        return rows.drop("_rank")
    first = dedupe_first(rows, ["open_time"], ["_rank", *PRICES])
    return first.drop("_rank")
