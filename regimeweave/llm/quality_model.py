"""Naive Bayes support vectors: n-gram indicators scaled by log-count ratios, hinge loss, dual coordinate descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeweave.llm import common as C
from regimeweave.llm import features

BITS = 18
MAX_ROWS = 20_000
COST = 0.1
EPOCHS = 8
SMOOTH = 1.0
#: Bytes of labelled texts that the fit reads at most; their features take about twice as many on the driver.
MAX_BYTES = 1 << 27


@dataclass
class Model:
    weights: np.ndarray  # of the scaled indicators, per bucket
    squares: np.ndarray  # of the scales
    bias: float = 0.0
    slope: float = 1.0  # of the probability, by the margin
    shift: float = 0.0


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, bits: int, smooth: float) -> np.ndarray:
    """log of (share of the bucket in class 1 / share in class 0)."""
    counts = [np.full(1 << bits, smooth), np.full(1 << bits, smooth)]
    for row, label in zip(rows, y, strict=True):
        counts[int(label)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model: min |w|^2/2 + sum cost_i * hinge, by its dual, one row at a time.

    Rows have unit length after scaling; the cost of each class is balanced by its share.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    upper = cost * len(y) / 2 / share[y.astype(int)]
    x = []
    for row in rows:
        v = values[row]
        x.append(v / max(1e-12, np.sqrt((v * v).sum())))
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(y))
    order = np.arange(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            gradient = sign[i] * ((w[rows[i]] * x[i]).sum() + bias) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])  # |x|^2 + 1 for the bias is 2
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * x[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins of rows the model was not fitted on."""
    slope, shift = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        a = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        d = np.linalg.solve(a, np.array([(g * margin).sum(), g.sum()]))
        slope, shift = slope - d[0], shift - d[1]
    return float(slope), float(shift)


def feature_rows(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, y, buckets`` (32-bit integers as binary) of labelled texts."""

    def run(batches):
        for batch in batches:
            for first, last, data, bounds in C.text_chunks(batch, "text"):
                rows, bucket = features.ngram_buckets(data, bounds, bits)
                cut = np.searchsorted(rows, np.arange(last - first + 1))
                packed = [bucket[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(packed, pa.binary())], ["doc_id", "y", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.map_arrow(docs.select("doc_id", "text", F.col("y").cast("int").alias("y")), run, f"doc_id {kind}, y int, buckets binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS, max_bytes: int = MAX_BYTES) -> Model:
    """Fits on at most ``max_rows`` labelled rows of ``max_bytes`` together (half of each class), whose buckets come to the driver.

    Every chosen row is read whole.

    The last fifth of the sample by id hash calibrates the probabilities. Without labels of
    both classes, the model gives 0.5 everywhere.
    """
    sample = feature_rows(features.labelled(docs, labels, label, max_rows, max_bytes), bits).toArrow().to_pydict()
    order = sorted(range(len(sample["y"])), key=lambda i: (str(sample["doc_id"][i]), sample["buckets"][i]))
    rows = [np.frombuffer(sample["buckets"][i], "<i4") for i in order]
    y = np.array([sample["y"][i] for i in order], float)
    if len(set(y)) < 2:
        return Model(np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32))
    last = np.arange(len(y)) % 5 == 4 if min((y == 0).sum(), (y == 1).sum()) >= 50 else np.zeros(len(y), bool)
    train = np.flatnonzero(~last)
    ratios = log_count_ratios([rows[i] for i in train], y[train], bits, SMOOTH)
    w, bias = dual_coordinate_descent([rows[i] for i in train], ratios, y[train], COST, EPOCHS)
    model = Model((w * ratios).astype(np.float32), (ratios**2).astype(np.float32), bias)
    check = np.flatnonzero(last) if last.any() else train
    norms = [np.sqrt((ratios[rows[i]] ** 2).sum()) for i in check]
    margin = np.array([model.weights[rows[i]].sum() / max(1e-12, n) for i, n in zip(check, norms, strict=True)]) + bias
    model.slope, model.shift = calibrate(margin, y[check])
    return model


def score(docs: DataFrame, model: Model, bits: int = BITS, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``; whole texts, no shuffle.

    An empty or null text has no features and gets the score of the bias. Rows that repeat an
    id are scored one by one.
    """
    weights, squares = model.weights, model.squares
    bias, slope, shift = model.bias, model.slope, model.shift

    def run(batches):
        for batch in batches:
            for first, last, data, bounds in C.text_chunks(batch, "text"):
                rows, bucket = features.ngram_buckets(data, bounds, bits)
                n = last - first
                dot = np.bincount(rows, weights[bucket], n)
                length = np.sqrt(np.bincount(rows, squares[bucket], n))
                margin = dot / np.maximum(length, 1e-12) + bias
                p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(p)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = C.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")
    return scored.select("doc_id", features.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
