"""Linear models and perceptrons with row weights, many of them fitted side by side.

One step of a fit is one job over the rows, whatever the number of models: every task adds up the
gradients of all models over its rows in numpy, their sums meet by model and slice, and the driver moves each model's parameters (as many numbers as the
models have) by a limited-memory quasi-Newton step. Rows never leave the executors. The functions
that run in tasks are sent by value, so executors need no installed copy of the library.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from regimeweave.operators.lockstep import matrix, sums_over_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MEMORY = 10


@dataclass(frozen=True)
class Network:
    """One model: rectified hidden layers (none: a linear model) and a softmax over ``classes``.

    ``features`` names an array column of ``inputs`` numbers, ``target`` an array column with one mass per class: the
    row's weight times its soft target, or times a one at its label. A row with a null target is not the model's.
    """

    name: str
    features: str
    target: str
    inputs: int
    classes: int
    hidden: tuple[int, ...] = ()
    seed: int = 0
    decay: float = 1e-4

    @property
    def layers(self) -> list[tuple[int, int]]:
        sizes = [self.inputs, *self.hidden, self.classes]
        return list(zip(sizes[:-1], sizes[1:], strict=True))

    def start(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        parts = [np.r_[rng.normal(0.0, np.sqrt(2.0 / a), a * b), np.zeros(b)] for a, b in self.layers]
        if not self.hidden:
            parts[0] *= 0.01
        return np.concatenate(parts)

    def unpack(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.layers:
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def decayed(self) -> np.ndarray:
        """1 for weights, 0 for offsets."""
        return np.concatenate([np.r_[np.ones(a * b), np.zeros(b)] for a, b in self.layers])

    def forward(self, flat: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """What enters each layer, and the logarithms of the probabilities."""
        entered, layers = [], self.unpack(flat)
        for i, (w, b) in enumerate(layers):
            entered.append(x)
            x = x @ w + b
            if i < len(layers) - 1:
                x = np.maximum(x, 0.0)
        x = x - x.max(axis=1, keepdims=True)
        return entered, x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    def gradient(self, flat: np.ndarray, x: np.ndarray, mass: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed loss and gradient, without decay."""
        entered, log_p = self.forward(flat, x)
        delta = np.exp(log_p) * mass.sum(axis=1, keepdims=True) - mass
        parts = []
        for (w, _), a in zip(reversed(self.unpack(flat)), reversed(entered), strict=True):
            parts.append(np.r_[(a.T @ delta).ravel(), delta.sum(axis=0)])
            delta = (delta @ w.T) * (a > 0)
        return float(-(mass * log_p).sum()), np.concatenate(parts[::-1])


@dataclass
class Fitted:
    """A model's parameters and how its fit ended: mean loss with decay, largest gradient entry, validation macro-F1."""

    network: Network
    params: np.ndarray
    loss: float
    gradient: float
    first_gradient: float
    evaluations: int
    validation: float | None = None


class _Descent:
    """Limited-memory quasi-Newton steps with backtracking; the caller evaluates ``trial`` and reports back."""

    def __init__(self, x: np.ndarray, tolerance: float):
        self.trial, self.tolerance, self.done = x, tolerance, False
        self.x = self.f = self.g = self.direction = None
        self.step, self.pairs = 1.0, []

    def report(self, f: float, g: np.ndarray) -> bool:
        """Whether the trial was taken."""
        if self.x is not None and not f <= self.f + 1e-4 * self.step * float(self.g @ self.direction):
            self.step *= 0.5
            self.done = self.step < 1e-8
            self.trial = self.x + self.step * self.direction
            return False
        if self.x is not None:
            s, y = self.trial - self.x, g - self.g
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs[1 - MEMORY :], (s, y)]
        self.x, self.f, self.g = self.trial, f, g
        self.done = np.abs(g).max() <= self.tolerance
        q, kept = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        self.direction = -q
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / max(1e-12, float(np.abs(g).sum())))
        self.trial = self.x + self.step * self.direction
        return True


def macro_f1(cells: np.ndarray) -> float:
    """Unweighted mean F1 over the classes of a confusion matrix that occur as actual or predicted."""
    both = cells.sum(axis=0) + cells.sum(axis=1)
    seen = both > 0
    return float(np.mean(2 * np.diag(cells)[seen] / both[seen])) if seen.any() else 0.0


def _evaluate(rows: DataFrame, networks: list[Network], params: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each model of ``params``: summed loss, mass, confusion cells of the validation rows, gradient."""

    def add(batch: pa.RecordBatch, params: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        names = batch.schema.names
        part = batch.column(names.index("_part")).to_numpy(zero_copy_only=False)
        actual = batch.column(names.index("_actual")).to_numpy(zero_copy_only=False)
        widths = {networks[i].features: networks[i].inputs for i in params}
        features = {c: matrix(batch.column(names.index(c)), width) for c, width in widths.items()}
        for i, flat in params.items():
            net = networks[i]
            member, mass = matrix(batch.column(names.index(net.target)), net.classes)
            seen, x = features[net.features]
            both, at, of = np.intersect1d(seen, member, return_indices=True)
            x, mass, role = x[at], mass[of], part[both]
            k, total = net.classes, np.zeros(2 + net.classes**2 + len(flat))
            train, check = role == 0, role == 1
            if train.any():
                total[0], total[2 + k * k :] = net.gradient(flat, x[train], mass[train])
                total[1] = mass[train].sum()
            if check.any():
                guess = net.forward(flat, x[check])[1].argmax(axis=1)
                total[2 : 2 + k * k] = np.bincount(actual[both][check].astype(int) * k + guess, minlength=k * k)
            yield i, total

    found = sums_over_rows(rows, params, add)
    return {i: found.get(i, np.zeros(2 + networks[i].classes ** 2 + len(flat))) for i, flat in params.items()}


def fit_networks(
    rows: DataFrame,
    networks: Sequence[Network],
    train: str,
    validation: str | None = None,
    actual: str | None = None,
    steps: int = 100,
    tolerance: float = 1e-5,
    patience: int | None = None,
) -> list[Fitted]:
    """Full-batch fits of all ``networks`` in one job per step.

    Minimises for each model the mean over its mass of ``-log p`` plus ``decay / 2`` times its squared weights, over
    the rows where the SQL condition ``train`` holds and its target is not null; weights enter exactly, nothing is
    resampled. A fit ends when no gradient entry exceeds ``tolerance``, or after ``steps`` evaluations. With ``validation``
    (another condition) and ``actual`` (the label column) each model returns the parameters with the best
    macro-F1 there, and stops after ``patience`` taken steps without a better one. ``rows`` should be
    a written table: it is read once per step. Sums of one step depend on the order of the tasks in the last
    digits only. A model without rows, or with a mass of zero, is an error.
    """
    networks = list(networks)
    role = F.when(F.expr(train), 0).when(F.expr(validation) if validation else F.lit(False), 1).otherwise(2)
    columns = sorted({n.features for n in networks} | {n.target for n in networks})
    data = rows.select(
        role.cast("int").alias("_part"), F.coalesce(F.col(actual), F.lit(0)).cast("int").alias("_actual") if actual else F.lit(0).alias("_actual"),
        *[F.transform(c, lambda x: x.cast("double")).alias(c) for c in columns],
    ).where("_part < 2")
    moves = [_Descent(n.start(), tolerance) for n in networks]
    best: list[Fitted | None] = [None] * len(networks)
    first, waited, last = [0.0] * len(networks), [0] * len(networks), [0] * len(networks)
    for step in range(1, steps + 1):
        open_ = {i: m.trial for i, m in enumerate(moves) if not m.done}
        if not open_:
            break
        for i, sums in _evaluate(data, networks, open_).items():
            net, move, k = networks[i], moves[i], networks[i].classes
            if not sums[1] > 0:
                raise ValueError(f"model {net.name} has no training rows")
            shrink = net.decay * net.decayed() * move.trial
            f, g = sums[0] / sums[1] + 0.5 * float(shrink @ move.trial), sums[2 + k * k :] / sums[1] + shrink
            last[i] = step
            if not move.report(f, g):
                continue
            first[i] = first[i] or float(np.abs(g).max())
            score = macro_f1(sums[2 : 2 + k * k].reshape(k, k)) if validation else None
            if best[i] is None or score is None or score > best[i].validation:
                best[i], waited[i] = Fitted(net, move.x, f, float(np.abs(g).max()), first[i], step, score), 0
            else:
                waited[i] += 1
                move.done |= patience is not None and waited[i] >= patience
    for i, fitted in enumerate(best):
        fitted.evaluations = last[i]
    return best


def predict_networks(df: DataFrame, fitted: Sequence[Fitted], out: str = "probabilities") -> DataFrame:
    """Adds ``out``: for each model in turn its class probabilities; null where the features are null."""
    networks = [f.network for f in fitted]
    sent = df.sparkSession.sparkContext.broadcast([f.params for f in fitted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n = batch.schema.names, batch.num_rows
            answers = []
            for net, flat in zip(networks, sent.value, strict=True):
                held, x = matrix(batch.column(names.index(net.features)), net.inputs)
                p = np.exp(net.forward(flat, x)[1]) if len(held) else np.zeros((0, net.classes))
                rows: list[list[float] | None] = [None] * n
                for at, row in zip(held.tolist(), p.tolist(), strict=True):
                    rows[at] = row
                answers.append(rows)
            column = pa.array([list(r) for r in zip(*answers, strict=True)], pa.list_(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, out])

    schema = StructType([*df.schema.fields, StructField(out, ArrayType(ArrayType(DoubleType())))])
    return df.mapInArrow(run, schema)
