"""Weighted logistic regression with an L2 penalty by Newton's method.

Every step is one pass: tasks add up the gradient and the Gram matrix of their rows, the driver solves one
small system.  The loss is strictly convex, so the weights found are those of its only minimum.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRADIENT = 1e-13
HALVINGS = 30


@dataclass(frozen=True)
class LogisticModel:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def probability(self, columns: Sequence[Column]) -> Column:
        total = F.lit(self.intercept)
        for weight, column in zip(self.weights, columns):
            total = total + F.lit(weight) * column
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(
    df: DataFrame, features: Sequence[str], label: str, weight: str, iterations: int, penalty: float = 1.0
) -> LogisticModel:
    """Minimises the weighted log loss plus half the penalty times the squared weights; the intercept is free."""
    size = len(features) + 1
    at, best = np.zeros(size), None
    ridge = np.full(size, float(penalty))
    ridge[-1] = 0.0
    step = np.zeros(size)
    for _ in range(iterations):
        loss, gradient, gram, total = _sums(df, features, label, weight, at)
        if not total:
            return LogisticModel(tuple(features), (0.0,) * len(features), 0.0)
        loss += 0.5 * float(ridge @ at**2)
        if best is not None and loss > best * (1 + 1e-12) + 1e-12:
            step = step / 2  # too far: half way back
            if np.abs(step).max() < 2.0**-HALVINGS:
                break
            at = at - step
            continue
        gradient = gradient + ridge * at
        if np.abs(gradient).max() <= GRADIENT * total:
            break
        best = loss
        # A direction without any slope, such as a constant column besides the intercept, is left alone.
        step = np.linalg.lstsq(gram + np.diag(ridge), -gradient, rcond=None)[0]
        at = at + step
    return LogisticModel(tuple(features), tuple(map(float, at[:-1])), float(at[-1]))


def gradient_at(df: DataFrame, model: LogisticModel, label: str, weight: str, penalty: float = 1.0) -> np.ndarray:
    """The mean gradient at a model's weights, the intercept last; zero at the minimum."""
    at = np.array([*model.weights, model.intercept])
    _, gradient, _, total = _sums(df, model.features, label, weight, at)
    gradient[:-1] += penalty * at[:-1]
    return gradient / max(total, 1.0)


def _sums(
    df: DataFrame, features: Sequence[str], label: str, weight: str, at: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Loss, gradient, Gram matrix and weight of all rows."""
    size = len(features) + 1

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + size + size * size)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            x = np.column_stack([*columns[:-2], np.ones(batch.num_rows)])
            y, w = columns[-2].astype(float), columns[-1]
            z = x @ at
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
            sums[0] += w @ (np.logaddexp(0.0, z) - y * z)
            sums[1] += w.sum()
            sums[2:2 + size] += x.T @ (w * (p - y))
            sums[2 + size:] += (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["place", "value"])

    rows = df.select(*features, label, weight)
    table = rows.mapInArrow(add, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    sums = np.zeros(2 + size + size * size)
    sums[table["place"].to_numpy()] = table["value"].to_numpy()
    return float(sums[0]), sums[2:2 + size], sums[2 + size:].reshape(size, size), float(sums[1])
