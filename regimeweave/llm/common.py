"""Reading tables, shared storage and text helpers of the package.

Words are ``[^\\x20\\x09-\\x0D]+`` throughout. Functions that run inside Python tasks are sent by
value, so executors need no installed copy of the library.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__package__])

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder of the session."""
    from regimeweave.session import shared_dir  # here, for this module goes to the tasks and nothing else of the library does

    return f"{shared_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a table that several branches read; a lost executor costs its own tasks only."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Free the files of a table that ``stage`` has written; what reads it must have been written before."""
    spark = df.sparkSession
    folder = shared_folder(spark).rsplit("/", 1)[0] + "/"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        if folder.split(":", 1)[-1].lstrip("/") not in file:
            raise ValueError(f"{file} is not a staged table")
        path.getFileSystem(conf).delete(path, True)


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of a thousand rows, unless the session names another size: a batch of texts is held several times, on both sides."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(size) == "10000":
        df.sparkSession.conf.set(size, "1000")
    return df.mapInArrow(function, schema)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def rows_per(df: DataFrame, per: int) -> int:
    """Blocks of about ``per`` rows that the table fills."""
    return max(1, -(-df.count() // per))


# Inside Python tasks: texts as bytes and offsets, words as positions and hashes.

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[base] = have = np.cumprod(out)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.zeros(1, np.int64)
    if len(column):
        bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_chunks(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``size`` bytes of text, each with its bytes and offsets. A longer text is a range of its own."""
    data, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        last = min(last, rows)
        yield first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash modulo 2^64; ``span_hash`` reads any span off it."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(_BYTE_VALUE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    return mix64((prefix[end] - prefix[start]) * powers(_BASE_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of each row."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_IS_SPACE[data], out=inside[1:-1])
    here = inside[1:]
    opens = here & ~inside[:-1]
    closes = ~here & inside[:-1]
    edges = bounds[:-1][np.diff(bounds) > 0]
    both = edges[(edges > 0)]
    joined = both[inside[both] & inside[both + 1]]
    opens[joined] = True
    closes[joined] = True
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    return start, end, np.diff(np.searchsorted(start, bounds))
