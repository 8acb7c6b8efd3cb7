"""Labels, folds and logistic regression for the learned operators."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Every document whose CRC-32 of the id as text is divisible by 5; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """All (doc_id, label) rows with both, each once, and the size of both classes."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        "doc_id IS NOT NULL AND label IN (0, 1)").distinct()
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    return known, {c: sizes.get(c, 0) for c in (0, 1)}


def sampled_labels(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` (doc_id, label) rows of each class in hash order, and the size of both classes.

    Rows without id or label are left out; an id with both labels counts in both classes.
    """
    known, sizes = known_labels(labels, label)
    classes = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return classes[0].unionByName(classes[1]), sizes


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(features: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last one is the constant and is not penalised."""
    x = np.column_stack((features, np.ones(len(features))))
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    out = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ out)
        gradient = x.T @ (weight * (p - target)) + ridge @ out
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(out)), gradient)
        out -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return out


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], size: int, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """The weights at which a convex loss with ``penalty`` is least; ``sums`` gives its gradient and Hessian over all rows."""
    out = np.zeros(size)
    for _ in range(steps):
        gradient, hessian = sums(out)
        step = np.linalg.solve(hessian + (penalty + 1e-9) * np.eye(size), gradient + penalty * out)
        out -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return out
