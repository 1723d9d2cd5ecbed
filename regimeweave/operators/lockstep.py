"""Sums over all rows for many models at once: what an iterative fit of several models needs per step."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 1 << 16
KIND = "net int, at int, sums binary"


def _rows(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Small sums share a batch, of at most two slices."""
    held: list[tuple[int, int, np.ndarray]] = []
    for n, ((i, at), total) in enumerate(sums.items(), 1):
        held.append((i, at, total))
        if n == len(sums) or sum(len(t) for *_, t in held) >= SLICE:
            nets, places, parts = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nets, pa.int32()), pa.array(places, pa.int32()), pa.array([t.tobytes() for t in parts], pa.binary())], ["net", "at", "sums"]
            )
            held = []


def sums_over_rows(
    rows: DataFrame, params: dict[int, Any], add: Callable[[pa.RecordBatch, dict[int, Any]], Iterator[tuple[int, np.ndarray]]], merged: bool = True
) -> dict[int, np.ndarray]:
    """For each model the sum of the vectors that ``add(batch, params)`` yields with its number.

    One job: every task adds up its batches, a shuffle by model and slice adds up the tasks' sums as they arrive, so
    nothing larger than the models meets in one place. ``params``, as many numbers as the models have, is broadcast.
    A model for which no row yields anything is missing from the result. A caller who knows that the sums of all tasks are small may
    leave the shuffle out (``merged``); the driver adds them up then.
    """
    sent = rows.sparkSession.sparkContext.broadcast(params)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, vector in add(batch, sent.value):
                sums[i] = sums[i] + vector if i in sums else vector
        yield from _rows({(i, at): total[at : at + SLICE] for i, total in sums.items() for at in range(0, len(total), SLICE)})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                part = np.frombuffer(raw.as_buffer())
                sums[i, at] = sums[i, at] + part if (i, at) in sums else part
        yield from _rows(sums)

    parts = rows.mapInArrow(over, KIND)
    if merged:
        parts = parts.repartition("net", "at").mapInArrow(merge, KIND)
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.collect():  # the models' size, or that of few tasks' sums
        slices, part = found.setdefault(r.net, {}), np.frombuffer(r.sums)
        slices[r.at] = slices[r.at] + part if r.at in slices else part
    sent.unpersist()
    return {i: np.concatenate([part for _, part in sorted(slices.items())]) for i, slices in found.items()}


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a value, and their arrays as a matrix."""
    held = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
    flat = column.drop_null().flatten()
    if len(flat) != len(held) * width or flat.null_count:
        raise ValueError(f"every array must hold {width} numbers")
    return held, flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
