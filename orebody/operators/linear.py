"""Linear machines fitted for all folds and classes at once. A pass over the rows is one matrix product per Arrow batch
and gives the loss and its gradient; partial sums are added up in two steps, so the driver gets a bounded number of them.
The driver holds the weights (folds x features x classes) and moves them by L-BFGS."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = 32  # partial sums that the driver adds up


@dataclass(frozen=True)
class LinearModel:
    """weights[f]: of the rows that are not in folds[f], a row per feature and one for the constant, a column per class."""

    weights: np.ndarray
    folds: list[int]
    classes: list[float]

    def predict(self, features: Column, fold: Column | None = None) -> Column:
        """The class of largest score, by the weights of the row's own fold, which has not seen it."""
        weights, folds, classes, one = self.weights, np.array(self.folds), np.array(self.classes), fold is None

        def best(x: pd.Series, f: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.empty((0, weights.shape[1] - 1))
            out = np.full(len(x), np.nan)
            for k, name in enumerate(folds):
                own = np.ones(len(x), dtype=bool) if one else f.to_numpy() == name
                if own.any():
                    out[own] = classes[(rows[own] @ weights[k][:-1] + weights[k][-1]).argmax(axis=1)]
            return pd.Series(out)

        return F.pandas_udf(best, "double")(features, F.lit(0) if fold is None else fold)


def fourier_features(x: Column, dims: int, gamma: float, n: int = 256, seed: int = 7) -> Column:
    """Random Fourier features of an array column: their inner products approximate exp(-gamma |x-y|^2)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (dims, n)), rng.uniform(0, 2 * math.pi, n)

    def features(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.cos(np.stack(rows.to_numpy()) @ w + b) * math.sqrt(2 / n)))

    return F.pandas_udf(features, "array<double>")(x)


def squared_hinge(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One against the rest, summed over classes. Of each row the loss, and the slope by score."""
    sign = np.where(np.arange(scores.shape[1]) == y[:, None], 1.0, -1.0)
    short = np.maximum(0, 1 - sign * scores)
    return (short**2).sum(axis=1), -2 * sign * short


def softmax(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = -np.log(np.maximum(p[at, y], 1e-300))
    p[at, y] -= 1
    return loss, p


def lbfgs(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, tolerance: float = 1e-4, memory: int = 10) -> np.ndarray:
    """Minimises a smooth convex function: value gives it and its gradient. Ends where the gradient is `tolerance` of the
    first, or after so many passes."""
    x, (f, g) = start, value(start)
    first, pairs, passes = np.linalg.norm(g), [], 1
    while passes < steps and np.linalg.norm(g) > tolerance * max(first, 1e-12):
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, first)
        for (s, y), a in zip(pairs, reversed(kept)):
            q += (a - (y @ q) / (s @ y)) * s
        size = 1.0
        while True:
            f2, g2 = value(x - size * q)
            passes += 1
            if f2 <= f - 1e-4 * size * (g @ q) or passes >= steps or size < 1e-6:
                break
            size /= 2
        if f2 > f:
            break
        s, y = -size * q, g2 - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        x, f, g = x + s, f2, g2
    return x


def fit_folds(df: DataFrame, features: str, label: str, fold: str | None = None, loss: Callable = squared_hinge, strength: float = 1.0, steps: int = 60) -> LinearModel:
    """For each fold the machine of the rows outside it; without a fold one of all rows. It minimises the mean loss plus
    |w|^2 / (2 * strength * rows), the constant left out. Rows with a null label or feature are left out."""
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("f"))
    rows = rows.where("x is not null and y is not null and not exists(x, v -> v is null)").persist()
    try:
        seen = rows.groupBy("y", "f").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect()  # classes x folds rows
        classes, folds = sorted({r["y"] for r in seen}), sorted({r["f"] for r in seen})
        d, k = max((r["d"] for r in seen), default=0), len(classes)
        sizes = np.array([sum(r["n"] for r in seen if not fold or r["f"] != name) for name in folds], dtype=float)
        shape = (len(folds), d + 1, k)
        spark = df.sparkSession

        def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
            shared = spark.sparkContext.broadcast(flat.reshape(shape))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                w, total = shared.value, np.zeros(flat.size + 1)
                for b in batches:
                    if not b.num_rows:
                        continue
                    x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                    y, f = np.searchsorted(classes, b.column(1).to_numpy()), b.column(2).to_numpy()
                    for n, name in enumerate(folds):
                        own = f != name if fold else np.ones(len(f), dtype=bool)
                        loss_, slope = loss(x[own] @ w[n][:-1] + w[n][-1], y[own])
                        total[0] += loss_.sum() / sizes[n]
                        at = 1 + n * (d + 1) * k
                        total[at : at + (d + 1) * k] += np.concatenate([x[own].T @ slope, slope.sum(axis=0, keepdims=True)]).ravel() / sizes[n]
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

            def add(table: pa.Table) -> pa.Table:
                return pa.table({"v": pa.array([np.sum(table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1), axis=0)], pa.list_(pa.float64()))})

            parts = rows.mapInArrow(run, "v array<double>").withColumn("slot", F.spark_partition_id() % SUMS)
            sums = parts.groupBy("slot").applyInArrow(add, "v array<double>") if rows.rdd.getNumPartitions() > SUMS else parts
            got = np.sum([r["v"] for r in sums.select("v").collect()], axis=0)
            w = flat.reshape(shape).copy()
            w[:, -1] = 0
            w /= strength * sizes[:, None, None]
            shared.destroy()
            return float(got[0] + (w * flat.reshape(shape)).sum() / 2), got[1:] + w.ravel()

        best = lbfgs(value, np.zeros(int(np.prod(shape))), steps) if k else np.zeros(0)
        return LinearModel(best.reshape(shape), folds, classes)
    finally:
        rows.unpersist()
