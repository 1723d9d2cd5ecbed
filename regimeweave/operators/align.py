"""Joining windows with the windows, labels and files they belong to. All joins are equi-joins."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeweave.functions.predicates import timestamp_utc, unix_path
from regimeweave.functions.timing import interval
from regimeweave.operators.gaps import HOUR
from regimeweave.operators.quality import GateError, require_none, require_unique
from regimeweave.operators.skew import skew_join


def _sides(windows: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    rest = [c for c in windows.columns if c not in by]
    keys = [F.col(b) for b in by]
    inputs = windows.select(*keys, *[F.col(c).alias(f"input_{c}") for c in rest])
    targets = windows.select(*keys, *[F.col(c).alias(f"target_{c}") for c in rest])
    return inputs, targets


def pair_windows(windows: DataFrame, n: int, every: timedelta = HOUR, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each window with the one that starts exactly ``n`` steps later in the same source."""
    inputs, targets = _sides(windows, by)
    wanted = inputs.withColumn("target_start_time", F.col("input_start_time") + interval(every, n))
    pairs = wanted.join(targets, [*by, "target_start_time"]).where(
        (F.col("target_start_time") - F.col("input_stop_time")) == interval(every)
    )
    return pairs.withColumn(
        "pair_id",
        F.concat_ws("__", *by, F.col("input_sample_name"), F.lit("to"), F.col("target_sample_name")),
    )


def unpaired(windows: DataFrame, n: int, every: timedelta = HOUR, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Input windows without a usable target, and why."""
    inputs = windows.select(
        *by,
        F.col("sample_name").alias("input_sample_name"),
        F.col("start_time").alias("input_start_time"),
        F.col("stop_time").alias("input_stop_time"),
        (F.col("start_time") + interval(every, n)).alias("required_target_start_time"),
    )
    targets = windows.select(*by, F.col("start_time").alias("required_target_start_time"), F.lit(True).alias("_found"))
    joined = inputs.join(targets, [*by, "required_target_start_time"], "left")
    apart = (F.col("required_target_start_time") - F.col("input_stop_time")) != interval(every)
    reason = F.when(F.col("_found").isNull(), F.lit("exact_future_target_image_unavailable")).when(
        apart, F.lit("input_target_not_adjacent_by_one_hour")
    )
    return joined.withColumn("reason", reason).where("reason is not null").drop("_found", "input_stop_time")


def align_long(
    spans: DataFrame, labelled: DataFrame, n_in: int, n_out: int, by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Long inputs with the short window after them (target) and their own last short window (current).

    ``spans`` carries ``start_index``; both short windows must exist. Joins are on row index.
    """
    at = F.col("start_index")
    base = spans.select(
        *by,
        at.alias("input_start_index"),
        F.col("start_time").alias("input_start_time"),
        (at + n_in).alias("target_start_index"),
        (at + (n_in - n_out)).alias("current_start_index"),
    )
    target = labelled.select(
        *by,
        at.alias("target_start_index"),
        F.col("stop_time").alias("target_stop_time"),
        F.col("cluster_id").alias("target_cluster_id"),
        F.col("distances").alias("target_distances"),
    )
    current = labelled.select(*by, at.alias("current_start_index"), F.col("cluster_id").alias("input_cluster_id"))
    return base.join(target, [*by, "target_start_index"]).join(current, [*by, "current_start_index"])


def reconstruct_current(pairs: DataFrame, n_out: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Regime of the input's last ``n_out`` candles, looked up among the targets of all pairs."""
    known = pairs.groupBy(*by, F.col("target_start_index").alias("_a"), F.col("target_stop_index").alias("_z")).agg(
        F.min("target_cluster_id").alias("recent_input_cluster_id")
    )
    keyed = pairs.withColumns({"_a": F.col("input_stop_index") - (n_out - 1), "_z": F.col("input_stop_index")})
    return keyed.join(known, [*by, "_a", "_z"], "left").drop("_a", "_z")


def attach_labels(samples: DataFrame, labels: DataFrame, key: Sequence[str], label: str, strict: bool = True) -> DataFrame:
    """Many-to-one label join; duplicate label keys and, if ``strict``, unmatched samples stop the job."""
    held = labels.select(*key, label)
    if strict:
        require_unique(held, key, "label keys are not unique")
    joined = samples.join(held, [*key], "left")
    return require_none(joined, F.col(label).isNull(), key, "samples without a label") if strict else joined


def merge_labels(
    original: DataFrame, corrected: DataFrame, keep: Sequence[str], time: str = "input_start_time", by: Sequence[str] | None = None
) -> DataFrame:
    """Corrected columns joined to an older manifest by parsed timestamp; train keeps eligible rows only.

    Rows meet within the partition, and within the symbol where both sides have one. Several
    corrected rows for one key stop the job.
    """
    if by is None:
        by = [c for c in ("partition", "symbol") if c == "partition" or (c in original.columns and c in corrected.columns)]
    left = original.withColumn("_k", timestamp_utc(F.col(time))).drop(*keep)
    right = corrected.select(*by, timestamp_utc(F.col(time)).alias("_k"), *keep)
    require_unique(right, [*by, "_k"], "several corrected rows for one time")
    merged = left.join(right, [*by, "_k"]).drop("_k")
    return merged.where((F.col("partition") != "train") | F.col("training_eligible"))


def match_rate(merged: DataFrame, corrected: DataFrame, minimum: float = 0.98) -> DataFrame:
    """Per partition: rows written, rows expected, their ratio, and whether it reaches ``minimum`` and is at most 1."""
    due = (F.col("partition") != "train") | F.col("training_eligible")
    expected = corrected.groupBy("partition").agg(F.count_if(due).alias("expected"))
    written = merged.groupBy("partition").agg(F.count(F.lit(1)).alias("written"))
    rate = F.when(F.col("expected") > 0, F.col("written") / F.col("expected")).otherwise(F.lit(0.0))
    return (
        expected.join(written, "partition", "left")
        .na.fill(0, ["written"])
        .withColumn("match_rate", rate)
        .withColumn("passed", F.col("match_rate").between(minimum, 1.0))
    )


def time_column_overlap(df: DataFrame, wanted: DataFrame, key: str = "input_start_time") -> DataFrame:
    """Per column: share of parseable values and share whose timestamp is a wanted key; one pass over ``df``."""
    columns = df.columns
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "text")
    stamped = long.select("column", timestamp_utc(F.col("text")).alias("_k"))
    # a candidate column has few distinct values or many: merge copies before the join
    counted = stamped.groupBy("column", "_k").agg(F.count(F.lit(1)).alias("_n"))
    keys = wanted.select(timestamp_utc(F.col(key)).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    joined = counted.join(keys, "_k", "left")
    n = F.sum("_n")
    return joined.groupBy("column").agg(
        (F.sum(F.when(F.col("_k").isNotNull(), F.col("_n")).otherwise(0)) / n).alias("parsed_share"),
        (F.sum(F.when(F.col("_hit"), F.col("_n")).otherwise(0)) / n).alias("hit_share"),
    )


def pick_time_column(df: DataFrame, wanted: DataFrame, key: str = "input_start_time") -> DataFrame:
    """The column whose timestamps best overlap the wanted keys; the first column wins a tie."""
    order = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column"))
    usable = time_column_overlap(df, wanted, key).where("parsed_share >= 0.5 and hit_share > 0")
    return usable.orderBy(F.col("hit_share").desc(), order).limit(1)


def pick_image_column(df: DataFrame) -> DataFrame:
    """The column with the largest share of image-like file names; the first column wins a tie."""
    columns = df.columns
    looks = [F.avg(F.coalesce(F.col(f"`{c}`").cast("string").rlike(r"(?i)\.(jpg|jpeg|png)\s*$"), F.lit(False)).cast("int")).alias(c) for c in columns]
    shares = df.agg(*looks).unpivot([], columns, "column", "image_share")
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    return shares.where("image_share > 0").orderBy(F.col("image_share").desc(), order).limit(1)


def require_merge_columns(df: DataFrame, wanted: DataFrame, key: str = "input_start_time", least: float = 0.5) -> tuple[str, str]:
    """Names of the time and the image column of an older manifest; a best column below ``least`` of its rows stops the job."""
    found = []
    for kind, share, best in (("time", "hit_share", pick_time_column(df, wanted, key)), ("image", "image_share", pick_image_column(df))):
        row = best.first()  # one row
        if row is None or row[share] < least:
            at = "none" if row is None else f"{row['column']} at {row[share]:.3f}"
            raise GateError(f"no {kind} column with a share of {least}: best {at}, columns {df.columns}")
        found.append(row["column"])
    return found[0], found[1]


def require_match(merged: DataFrame, corrected: DataFrame, minimum: float = 0.98) -> DataFrame:
    """``merged``, or an error that names every partition whose ``match_rate`` does not pass."""
    failed = match_rate(merged, corrected, minimum).where(~F.col("passed")).orderBy("partition").collect()  # one row per partition
    if failed:
        raise GateError("match rate low: " + ", ".join(f"{r['partition']} {r['written']} of {r['expected']}" for r in failed))
    return merged


def _sum(value: str | Column) -> Column:
    """Sum that is zero for no rows."""
    return F.coalesce(F.sum(value), F.lit(0))


def check_conserved(original: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """One row: are the parts duplicate-free, disjoint, and together exactly the original ids."""
    tagged = original.select(F.col(key).alias("id"), F.lit("").alias("part"))
    for name, part in parts.items():
        tagged = tagged.unionByName(part.select(F.col(key).alias("id"), F.lit(name).alias("part")))
    per_part = tagged.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("part") != ""
    per_id = per_part.groupBy("id").agg(
        F.count_if(~inside).alias("in_original"),
        F.count_if(inside).alias("in_parts"),
        F.count_if(inside & (F.col("n") > 1)).alias("repeated"),
    )
    counted = per_id.agg(
        F.count_if(F.col("in_original") > 0).alias("original_ids"),
        F.count_if(F.col("in_parts") > 0).alias("part_ids"),
        _sum("repeated").alias("repeated_inside_a_part"),
        F.count_if(F.col("in_parts") > 1).alias("shared_by_parts"),
        F.count_if((F.col("in_original") > 0) & (F.col("in_parts") == 0)).alias("lost"),
        F.count_if((F.col("in_original") == 0) & (F.col("in_parts") > 0)).alias("invented"),
    )
    bad = F.col("repeated_inside_a_part") + F.col("shared_by_parts") + F.col("lost") + F.col("invented")
    return counted.withColumn("conserved", bad == 0)


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """One row: do two tables hold the same keys, as often, and in the same rank order."""
    tagged = a.select(*keys, rank, F.lit(1).alias("_s")).unionByName(b.select(*keys, rank, F.lit(-1).alias("_s")))
    net = tagged.groupBy(*keys, rank).agg(F.sum("_s").alias("_net"), F.count_if(F.col("_s") > 0).alias("_a"), F.count_if(F.col("_s") < 0).alias("_b"))
    report = net.agg(
        _sum("_a").alias("rows_stored"),
        _sum("_b").alias("rows_current"),
        _sum(F.greatest("_net", F.lit(0))).alias("only_stored"),
        _sum(F.greatest(-F.col("_net"), F.lit(0))).alias("only_current"),
    )
    return report.withColumn("compatible", (F.col("only_stored") == 0) & (F.col("only_current") == 0))


def missing_files(manifest: DataFrame, files: DataFrame, path: str = "image_path") -> DataFrame:
    """Manifest rows whose normalised path is not among the listed files."""
    wanted = manifest.withColumn("_p", unix_path(F.col(path)))
    present = files.select(unix_path(F.col("path")).alias("_p"))
    return wanted.join(present, "_p", "left_anti").drop("_p")


def _base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def resolve_paths(manifest: DataFrame, files: DataFrame, root: str, path: str = "image_path") -> DataFrame:
    """Resolve each path: as given, below ``root``, below ``root/images``, else by file name.

    Listed paths are merged per name first, so a name used by many folders costs one row.
    ``ambiguous`` counts the other files of that name; the smallest path wins.
    """
    listed = files.select(unix_path(F.col("path")).alias("_f")).distinct()
    names = listed.where(F.lower("_f").rlike(r"\.(jpg|jpeg|png)$")).groupBy(_base_name(F.col("_f")).alias("_name")).agg(
        F.min("_f").alias("_by_name"), (F.count(F.lit(1)) - 1).alias("ambiguous")
    )
    base = root.rstrip("/")
    given = unix_path(F.col(path))
    rows = manifest.withColumns(
        {
            "_w0": given,
            "_w1": F.concat(F.lit(f"{base}/"), given),
            "_w2": F.concat(F.lit(f"{base}/images/"), given),
            "_name": _base_name(given),
        }
    )
    for i in range(3):
        rows = rows.join(listed.select(F.col("_f").alias(f"_w{i}"), F.lit(True).alias(f"_hit{i}")), f"_w{i}", "left")
    exact = F.coalesce(*[F.when(F.col(f"_hit{i}"), F.col(f"_w{i}")) for i in range(3)])
    # one file name may serve most of the manifest
    rows = skew_join(rows, names, "_name", "left")
    return rows.select(
        *manifest.columns,
        F.coalesce(exact, F.col("_by_name")).alias("resolved_path"),
        F.when(exact.isNull() & F.col("_by_name").isNotNull(), F.col("ambiguous")).otherwise(F.lit(0)).alias("ambiguous"),
    )


def agreement(a: DataFrame, b: DataFrame, key: Sequence[str], label: str = "cluster_id") -> DataFrame:
    """Share of rows that two labelings of the same rows agree on."""
    joined = a.select(*key, F.col(label).alias("_a")).join(b.select(*key, F.col(label).alias("_b")), [*key])
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement")
    )


