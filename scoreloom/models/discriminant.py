"""Linear and quadratic discriminant posteriors from class moments.

Every partition reduces its rows to counts, means and centred cross products, a d x d block for each class (and fold), whatever the row
count. Blocks are merged pairwise, so nothing has to be shifted or read before, in two streamed steps; one of each class and fold
reaches the driver. Training sets of a cross-fit are the total less one fold. Rows are scored as matrix products, so
the width only costs arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.scaling import Prepared

MERGE_TASKS = 32

#: (rows, mean, sum of centred cross products)
Moments = tuple[int, np.ndarray, np.ndarray]


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of two disjoint sets of rows."""
    (n, m, s), (k, o, t) = a, b
    if not n or not k:
        return a if n else b
    away = o - m
    return n + k, m + away * (k / (n + k)), s + t + np.outer(away, away) * (n * k / (n + k))


def less(a: Moments, b: Moments) -> Moments:
    """Moments of the rows of ``a`` that aren't in ``b``."""
    (n, m, s), (k, o, t) = a, b
    if not k:
        return a
    if n == k:
        return 0, np.zeros_like(m), np.zeros_like(s)
    mean = (n * m - k * o) / (n - k)
    away = o - mean
    return n - k, mean, s - t - np.outer(away, away) * (k * (n - k) / n)


def moments(data: Prepared, fold: str | None = None) -> dict[tuple[int, int], Moments]:
    """{(fold, class): moments} of the labelled rows in one pass; without ``fold`` all rows are in fold 0."""
    names, d = data.features, len(data.features)
    part = (F.col(fold) if fold else F.lit(0)).cast("int").alias("_fold")
    labelled = data.labelled.select(data.label, part, *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)])

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], Moments] = {}
        for pdf in parts:
            x = pdf.iloc[:, 2:].to_numpy(dtype=float)
            for (y, f), rows in pdf.groupby([pdf.iloc[:, 0], "_fold"]).indices.items():
                own = x[rows]
                mean = own.mean(axis=0)
                away = own - mean
                key = int(f), int(y)
                found = (len(own), mean, away.T @ away)
                total[key] = merged(total[key], found) if key in total else found
        yield _frame(total)

    def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], Moments] = {}
        for pdf in parts:
            for f, c, values in zip(pdf["fold"], pdf["cls"], pdf["block"], strict=True):
                key, found = (int(f), int(c)), _unpacked(values, d)
                total[key] = merged(total[key], found) if key in total else found
        yield _frame(total)

    # blocks are streamed and merged on the way: many tasks to a few, those to one, and one block of each class and fold to the driver
    kind = "fold int, cls int, block binary"
    partials = labelled.mapInPandas(blocks, kind).repartition(MERGE_TASKS).mapInPandas(added, kind)
    return {(r["fold"], r["cls"]): _unpacked(r["block"], d) for r in partials.coalesce(1).mapInPandas(added, kind).collect()}


def _unpacked(values: bytes, d: int) -> Moments:
    v = np.frombuffer(values)
    return int(v[0]), v[1 : d + 1], v[d + 1 :].reshape(d, d)


def _frame(total: dict[tuple[int, int], Moments]) -> pd.DataFrame:
    flat = [np.concatenate([[n], mean, scatter.ravel()]).tobytes() for n, mean, scatter in total.values()]
    return pd.DataFrame({"fold": [f for f, _ in total], "cls": [c for _, c in total], "block": flat})


def class_moments(data: Prepared) -> dict[int, Moments]:
    """{class: moments} over the labelled rows."""
    return {c: found for (_, c), found in moments(data).items()}


def _scored(data: Prepared, name: str, log_odds) -> DataFrame:
    """``log_odds`` maps a block of rows to one number each."""
    kept = data.frame.select(data.id, *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(data.features)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            odds = log_odds(pdf.iloc[:, 1:].to_numpy(dtype=float))
            yield pd.DataFrame({data_id: pdf.iloc[:, 0], name: 1 / (1 + np.exp(-np.clip(odds, -700, 700)))})

    data_id = data.id
    kind = dict(data.frame.dtypes)[data.id]
    return kept.mapInPandas(run, f"`{data.id}` {kind}, `{name}` double")


def _linear(classes: dict[int, Moments], solver: str):
    (n0, m0, s0), (n1, m1, s1) = classes[0], classes[1]
    n = n0 + n1
    pooled = (s0 + s1) / (n - 2 if solver == "svd" else n)
    weights = np.linalg.pinv(pooled) @ (m1 - m0)
    middle, prior = 0.5 * (m0 + m1), np.log(n1 / n0)
    return lambda x: (x - middle) @ weights + prior


def _quadratic(classes: dict[int, Moments]):
    parts = []
    for c, sign in ((0, -1.0), (1, 1.0)):
        n, mean, scatter = classes[c]
        cov = scatter / (n - 1)
        parts.append((sign, mean, np.linalg.pinv(cov), np.log(n) - 0.5 * np.linalg.slogdet(cov)[1]))

    def log_odds(x):
        total = np.zeros(len(x))
        for sign, mean, inverse, constant in parts:
            away = x - mean
            total += sign * (constant - 0.5 * ((away @ inverse) * away).sum(axis=1))
        return total

    return log_odds


def linear_discriminant(data: Prepared, solver: str = "svd", name: str | None = None) -> DataFrame:
    """Posterior of class 1 under one pooled covariance.

    ``svd`` divides the pooled scatter by n - 2, ``lsqr`` by n.
    """
    return _scored(data, name or f"linear_discriminant_analysis_{solver}_solver", _linear(class_moments(data), solver))


def quadratic_discriminant(data: Prepared, name: str = "quadratic_discriminant_analysis") -> DataFrame:
    """Posterior of class 1 with one covariance per class."""
    return _scored(data, name, _quadratic(class_moments(data)))


def held_out(data: Prepared, fold: str, form: str = "linear", name: str = "held_out") -> DataFrame:
    """``id, fold, name`` of the labelled rows, each scored by the discriminant of the other folds; one pass for all moments."""
    found = moments(data, fold)
    folds = sorted({f for f, _ in found})
    odds = {}
    for f in folds:
        rest = {c: less(reduce(merged, [found[k, c] for k in folds if (k, c) in found]), found[f, c]) if (f, c) in found
                else reduce(merged, [found[k, c] for k in folds if (k, c) in found]) for c in (0, 1)}
        odds[f] = _linear(rest, "svd") if form == "linear" else _quadratic(rest)
    kind = dict(data.frame.dtypes)[data.id]
    values = [F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(data.features)]
    rows = data.labelled.select(F.col(data.id).alias("_id"), F.col(fold).cast("int").alias("_fold"), *values)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x, out = pdf.iloc[:, 2:].to_numpy(dtype=float), np.zeros(len(pdf))
            for f, own in pdf.groupby("_fold").indices.items():
                out[own] = odds[int(f)](x[own])
            yield pd.DataFrame({"id": pdf["_id"], "fold": pdf["_fold"], "score": 1 / (1 + np.exp(-np.clip(out, -700, 700)))})

    return rows.mapInPandas(run, f"id {kind}, fold int, score double").toDF(data.id, fold, name)
