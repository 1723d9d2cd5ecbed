"""Manifests, vectors, reports and skip logs on disk."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from regimeweave.operators.quality import GateError, require_domain, require_finite, require_unique

# write policy names and the Spark save modes they stand for
MODES = {"error": "errorifexists", "resume": "ignore", "overwrite": "overwrite"}


def save_mode(policy: str) -> str:
    if policy not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    return MODES[policy]


def write_manifests(
    pairs: DataFrame, path: str, mode: str = "error", order: str = "chronological_rank", fmt: str = "parquet", files: int | None = None
) -> None:
    """One folder per partition, rows in ``order`` inside and across the files of a partition.

    A range layout on (partition, order) spreads a large partition over many files; no
    partition is gathered in one task.
    """
    layout = pairs.repartitionByRange(*([files] if files else []), "partition", order)
    writer = layout.sortWithinPartitions("partition", order).write.mode(save_mode(mode)).partitionBy("partition")
    writer.format(fmt).save(path) if fmt != "csv" else writer.option("header", True).csv(path)


def write_manifest_set(pairs: DataFrame, root: str, mode: str = "error") -> None:
    """The chronological and the shuffled copy of a manifest that carries both ranks."""
    write_manifests(pairs, f"{root}/chronological", mode, "chronological_rank")
    write_manifests(pairs, f"{root}/shuffled", mode, "shuffled_rank")


@dataclass(frozen=True)
class Contract:
    """What a manifest must satisfy before it is used."""

    schema: StructType
    key: str = "pair_id"
    domains: dict[str, Sequence] = field(default_factory=dict)
    finite: Sequence[str] = ()
    empty: bool = False  # may it have no rows


def check_manifest(df: DataFrame, contract: Contract) -> DataFrame:
    missing = [f.name for f in contract.schema.fields if f.name not in df.columns]
    if missing:
        raise GateError(f"manifest lacks columns {missing}")
    if not contract.empty and df.isEmpty():
        raise GateError("manifest is empty")
    require_unique(df, [contract.key])
    for column, values in contract.domains.items():
        require_domain(df, column, values, [contract.key])
    if contract.finite:
        require_finite(df, contract.finite, [contract.key])
    return df


def read_manifest(spark: SparkSession, path: str, contract: Contract, fmt: str = "parquet") -> DataFrame:
    """Read with the declared schema, then check it; nothing is inferred."""
    if fmt == "csv":
        df = spark.read.schema(contract.schema).option("header", True).option("enforceSchema", False).csv(path)
    else:
        try:
            stored = spark.read.parquet(path)
        except AnalysisException as e:
            # a partitioned write of no rows leaves a folder without files
            if not contract.empty or e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            stored = spark.createDataFrame([], contract.schema)
        missing = [f.name for f in contract.schema.fields if f.name not in stored.columns]
        if missing:
            raise GateError(f"manifest lacks columns {missing}")
        df = stored.select(*[F.col(f.name).cast(f.dataType) for f in contract.schema.fields])
    return check_manifest(df, contract)


def write_features(df: DataFrame, path: str, key: str, vectors: Sequence[str], mode: str = "error") -> None:
    """Vectors keyed by id, stored as float arrays next to the remaining columns."""
    stored = df.select(*[F.transform(c, lambda x: x.cast("float")).alias(c) if c in vectors else F.col(c) for c in df.columns])
    if key not in df.columns or any(not isinstance(df.schema[v].dataType, ArrayType) for v in vectors):
        raise GateError("a vector table needs its key and array columns")
    stored.write.mode(save_mode(mode)).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "error") -> None:
    """A one-row report as one JSON line; more than one row is refused before anything is written."""
    if len(df.limit(2).collect()) != 1:
        raise GateError("a report must have exactly one row")
    df.select(F.to_json(F.struct(*df.columns))).coalesce(1).write.mode(save_mode(mode)).text(path)


def write_skips(df: DataFrame, path: str, mode: str = "error") -> None:
    """Skipped rows as JSON lines with sorted keys; no rows give an empty dataset."""
    df.select(*sorted(df.columns)).write.mode(save_mode(mode)).json(path)
