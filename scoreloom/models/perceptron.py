"""Multilayer perceptron with ReLU layers and an L2 term, fitted by L-BFGS.

The loss is the mean log loss plus ``alpha / 2`` times the squared weights (no biases) over the number of rows. In each step every partition
runs its rows forward and back in numpy and leaves one block, loss and gradient; blocks are added in two streamed steps and one reaches
the driver, where the step is taken. What is sent and held is as large as the network, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.scaling import Prepared
from ..session import cut_lineage

# Layers, L2 strength, most steps and the gradient that ends them.
HIDDEN = (500, 150, 30, 2)
ALPHA = 80.0
STEPS = 500
TOLERANCE = 1e-4
MEMORY = 10  # pairs of steps that L-BFGS remembers
TASK_ROWS = 20_000  # rows of a task


class Network:
    """Shapes of the layers; parameters are one flat vector."""

    def __init__(self, inputs: int, hidden: Sequence[int] = HIDDEN):
        sizes = [inputs, *hidden, 1]
        self.shapes = list(zip(sizes[:-1], sizes[1:], strict=True))
        self.size = sum((a + 1) * b for a, b in self.shapes)

    def start(self, seed: int = 1) -> np.ndarray:
        rng = np.random.default_rng(seed)
        bounds = [np.sqrt((2.0 if k == len(self.shapes) - 1 else 6.0) / (a + b)) for k, (a, b) in enumerate(self.shapes)]
        return np.concatenate([rng.uniform(-bound, bound, (a + 1) * b) for bound, (a, b) in zip(bounds, self.shapes, strict=True)])

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """Values of every layer; the last is the log odds."""
        values = [x]
        layers = self.layers(flat)
        for k, (w, bias) in enumerate(layers):
            z = values[-1] @ w + bias
            values.append(z if k == len(layers) - 1 else np.maximum(z, 0.0))
        return values

    def loss(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed log loss of the rows and its gradient."""
        values, layers = self.forward(flat, x), self.layers(flat)
        odds = values[-1][:, 0]
        loss = np.logaddexp(0.0, odds).sum() - (y * odds).sum()
        back = (1 / (1 + np.exp(-np.clip(odds, -700, 700))) - y)[:, None]
        parts: list[np.ndarray] = []
        for k in range(len(layers) - 1, -1, -1):
            parts.append(np.concatenate([(values[k].T @ back).ravel(), back.sum(axis=0)]))
            back = (back @ layers[k][0].T) * (values[k] > 0)
        return float(loss), np.concatenate(parts[::-1])

    def weights(self) -> np.ndarray:
        """Which parameters are weights and not biases."""
        return np.concatenate([np.repeat([True, False], [a * b, b]) for a, b in self.shapes])


def lbfgs(start: np.ndarray, value: Callable[[np.ndarray], tuple[float, np.ndarray]], steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float, int]:
    """(point, value, steps) of a minimum, by limited-memory quasi-Newton steps with a halving line search."""
    x = start
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for done in range(steps):
        if np.abs(g).max() <= tolerance:
            return x, f, done
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            kept.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - y @ q / (s @ y))
        slope = g @ q
        if slope <= 0:
            q, slope, pairs = g, g @ g, []
        size = 1.0 if pairs else min(1.0, 1.0 / np.abs(g).sum())
        for _ in range(30):
            new = x - size * q
            f_new, g_new = value(new)
            if f_new <= f - 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x, f, done
        if (s := new - x) @ (y := g_new - g) > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-MEMORY:]
        still = f - f_new <= 2.2e-9 * max(abs(f), abs(f_new), 1.0)
        x, f, g = new, f_new, g_new
        if still:
            return x, f, done + 1
    return x, f, steps


def _added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for pdf in parts:
        for block in pdf["block"]:
            own = np.frombuffer(block)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pd.DataFrame({"block": [total.tobytes()]})


def _matrix(pdf: pd.DataFrame, first: int) -> np.ndarray:
    return pdf.iloc[:, first:].to_numpy(dtype=float)


def fitted(data: Prepared, hidden: Sequence[int] = HIDDEN, alpha: float = ALPHA, steps: int = STEPS) -> tuple[Network, np.ndarray, int]:
    """(network, parameters, steps taken) over all labelled rows."""
    network = Network(len(data.features), hidden)
    columns = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(data.features)]
    rows = cut_lineage(data.labelled.select(F.col(data.label).cast("double").alias("y"), *columns))
    spark, n, weights = rows.sparkSession, rows.count(), network.weights()
    tasks = max(1, -(-n // TASK_ROWS))

    def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(flat)

        def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(network.size + 1)
            for pdf in parts:
                loss, gradient = network.loss(shared.value, _matrix(pdf, 1), pdf["y"].to_numpy())
                total += np.concatenate([[loss], gradient])
            yield pd.DataFrame({"block": [total.tobytes()]})

        made = rows.coalesce(tasks).mapInPandas(blocks, "block binary")
        if tasks > 1:  # blocks are added by the root of as many tasks, and their sums by one
            made = made.repartition(math.isqrt(tasks)).mapInPandas(_added, "block binary").coalesce(1).mapInPandas(_added, "block binary")
        total = np.frombuffer(made.first()["block"])
        shared.unpersist()
        pull = np.where(weights, flat, 0.0)
        return (total[0] + alpha / 2 * (pull @ pull)) / n, (total[1:] + alpha * pull) / n

    flat, _, taken = lbfgs(network.start(), value, steps)
    return network, flat, taken


def perceptron(data: Prepared, name: str = "mlp", hidden: Sequence[int] = HIDDEN, alpha: float = ALPHA, steps: int = STEPS) -> DataFrame:
    """Probability of class 1 of every row."""
    network, flat, _ = fitted(data, hidden, alpha, steps)
    shared = data.frame.sparkSession.sparkContext.broadcast(flat)
    kind = dict(data.frame.dtypes)[data.id]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            odds = network.forward(shared.value, _matrix(pdf, 1))[-1][:, 0]
            yield pd.DataFrame({"id": pdf["id"], "score": 1 / (1 + np.exp(-np.clip(odds, -700, 700)))})

    columns = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(data.features)]
    return data.frame.select(F.col(data.id).alias("id"), *columns).mapInPandas(run, f"id {kind}, score double").toDF(data.id, name)
