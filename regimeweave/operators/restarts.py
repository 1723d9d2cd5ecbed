"""K-means from many starts at once: one job per iteration, whatever the number of starts."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeweave.operators.lockstep import matrix, sums_over_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START_ROWS = 4096
BLOCK = 1 << 15  # numbers in a matrix of rows
MOST = 1 << 24  # numbers of a task
FEW = 1 << 22  # numbers that the driver adds up itself
STEP_ROWS = 512  # rows and centers compared at once
STEP_CENTERS = 1024


@dataclass
class Clusters:
    centers: list[list[float]]
    cost: float
    iterations: int


def spread_start(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Rows of the sample drawn one after another with chances by squared distance to those drawn before."""
    rng = np.random.default_rng(seed)
    picked = [sample[rng.integers(len(sample))]]
    near = ((sample - picked[0]) ** 2).sum(axis=1)
    while len(picked) < k:
        total = near.sum()
        at = rng.choice(len(sample), p=near / total) if total > 0 else rng.integers(len(sample))
        picked.append(sample[at])
        near = np.minimum(near, ((sample - picked[-1]) ** 2).sum(axis=1))
    return np.stack(picked)


def _blocks(rows: DataFrame, width: int, shift: np.ndarray) -> tuple[DataFrame, int]:
    """``points`` and the number of tasks: the vectors less ``shift`` as matrices of ``BLOCK`` numbers, dealt evenly over the tasks however the rows lie in
    their files, so that an iteration moves bytes instead of array elements."""
    per = max(1, BLOCK // width)
    numbers = rows.count() * width
    tasks = max(min(rows.sparkSession.sparkContext.defaultParallelism, -(-numbers // BLOCK)), -(-numbers // MOST))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), width)[1] - shift
            for at in range(0, len(x), per):
                yield pa.RecordBatch.from_arrays([pa.array([x[at : at + per].tobytes()], pa.binary())], ["points"])

    return rows.mapInArrow(pack, "points binary").repartition(tasks), tasks


def _step(x: np.ndarray, fits: list[np.ndarray], costs: list[bool]) -> Iterator[np.ndarray]:
    """For each of ``fits``, which have equally many centers: cost (0 unless in ``costs``), rows and sum of rows by nearest center."""
    k, width = fits[0].shape
    together = np.stack(fits, axis=1).reshape(-1, width)  # first centers of all fits, then the second, and so on
    half = (together * together).sum(axis=1)[:, None] / 2
    cost, n, total = np.zeros(len(fits)), np.zeros((k, len(fits))), np.zeros((k * len(fits), width))
    for at in range(0, len(x), STEP_ROWS):
        part = x[at : at + STEP_ROWS]
        far = (half - together @ part.T).reshape(k, len(fits), -1)
        best, own = far[0].copy(), np.zeros(far.shape[1:], np.int32)
        for c in range(1, k):  # the first of equally near centers
            np.copyto(own, c, where=far[c] < best)
            np.minimum(best, far[c], out=best)
        hot = (own == np.arange(k, dtype=np.int32)[:, None, None]).astype(float)
        n += hot.sum(axis=2)
        total += hot.reshape(len(together), -1) @ part
        for j in np.flatnonzero(costs):
            cost[j] += ((part - fits[j][own[j]]) ** 2).sum()
    for j in range(len(fits)):
        yield np.r_[cost[j], n[:, j], total[j :: len(fits)].ravel()]


def fit_kmeans_many(
    df: DataFrame, vector: str, starts: Sequence[tuple[int, int]], max_iter: int = 300, tol: float = 1e-4, start_rows: int = START_ROWS
) -> list[Clusters]:
    """Lloyd's iterations over all rows from every ``(k, seed)`` of ``starts``.

    A start is drawn from at most ``start_rows`` rows, the same for all (by a hash of the vector); everything after
    that reads all rows. A fit ends when no center moves by more than ``tol``, or after ``max_iter`` iterations; an empty
    cluster keeps its center. ``cost`` is the sum of squared distances to the returned centers. Rows with a null
    vector are left out; without any row there is nothing to fit, an error.
    """
    rows = df.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).where("v is not null")
    sample = rows.orderBy(F.xxhash64("v"), "v").limit(start_rows).collect()
    if not sample:
        raise ValueError("no rows to fit")
    first = np.array([r.v for r in sample])
    shift = first.mean(axis=0)  # distances near the data's middle lose no digits
    width = first.shape[1]

    def add(batch: pa.RecordBatch, params: dict[int, tuple[np.ndarray, bool]]) -> Iterator[tuple[int, np.ndarray]]:
        alike: dict[int, list[int]] = {}
        for i, (centers, _) in params.items():
            alike.setdefault(len(centers), []).append(i)
        x = np.concatenate([np.frombuffer(points.as_buffer()) for points in batch.column(0)]).reshape(-1, width)
        for k, fits in alike.items():
            most = max(1, STEP_CENTERS // k)
            for some in (fits[at : at + most] for at in range(0, len(fits), most)):
                yield from zip(some, _step(x, [params[i][0] for i in some], [params[i][1] for i in some]), strict=True)

    blocks, tasks = _blocks(rows, width, shift)
    held = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    size = sum(1 + k + k * width for k, _ in starts)
    try:
        centers = {i: spread_start(first, k, seed) - shift for i, (k, seed) in enumerate(starts)}
        done: dict[int, Clusters] = {}
        settled: set[int] = set()
        for iteration in range(max_iter + 1):
            todo = {i: (c, i in settled or iteration == max_iter) for i, c in centers.items() if i not in done}
            if not todo:
                break
            for i, sums in sums_over_rows(held, todo, add, merged=tasks * size > FEW).items():
                k = len(centers[i])
                if todo[i][1]:
                    done[i] = Clusters((centers[i] + shift).tolist(), float(sums[0]), iteration)
                    continue
                n, total = sums[1 : 1 + k], sums[1 + k :].reshape(k, width)
                moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers[i])
                if ((moved - centers[i]) ** 2).sum(axis=1).max() <= tol**2:
                    settled.add(i)
                centers[i] = moved
    finally:
        held.unpersist()
    return [done[i] for i in range(len(starts))]
