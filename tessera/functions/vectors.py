"""Vector metrics as Column expressions, and in blocks for many queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import invalid

EPSILON = 1.1920929e-07
METRICS = ("l2", "cosine", "dot")


def metric_name(name: str) -> str:
    low = str(name).lower()
    if low not in METRICS:
        raise invalid("metric must be l2, cosine or dot")
    return low


def vector(values: list[float], kind: str = "double") -> Column:
    return F.array(*[F.lit(float(x)) for x in values]).cast(f"array<{kind}>")


def _fold(a: Column, b: Column, f, kind: str) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0).cast(kind), lambda s, x: s + x)


def l2(a: Column, b: Column, kind: str = "double") -> Column:
    """Squared Euclidean distance."""
    return _fold(a, b, lambda x, y: (x.cast(kind) - y.cast(kind)) * (x.cast(kind) - y.cast(kind)), kind)


def inner(a: Column, b: Column, kind: str = "double") -> Column:
    return _fold(a, b, lambda x, y: x.cast(kind) * y.cast(kind), kind)


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    return -inner(a, b, kind)


def cosine(a: Column, b: Column, kind: str = "double") -> Column:
    """1 - cosine similarity; 1 for a zero vector."""
    norm = F.sqrt(inner(a, a, kind) * inner(b, b, kind)).cast(kind)
    return F.lit(1.0).cast(kind) - inner(a, b, kind) / F.greatest(norm, F.lit(EPSILON).cast(kind))


def distance(metric: str, a: Column, b: Column, kind: str = "double") -> Column:
    return {"l2": l2, "cosine": cosine, "dot": dot}[metric_name(metric)](a, b, kind)


def block(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of rows of x to rows of q, in doubles."""
    metric = metric_name(metric)
    if metric == "l2":
        # differences, not the expanded square: no cancellation for near vectors
        return np.stack([((x - v) ** 2).sum(1) for v in q], 1) if len(q) else np.zeros((len(x), 0))
    prod = x @ q.T
    if metric == "dot":
        return -prod
    norm = np.sqrt((x * x).sum(1)[:, None] * (q * q).sum(1)[None])
    return 1 - prod / np.maximum(norm, EPSILON)


def paired(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of columns of x to the same columns of q, summed component by component as the expressions are: a matrix
    product's sums depend on where a vector stands, these do not, so equal vectors tie."""

    def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(x.shape[1])
        for u, v in zip(a, b):
            total += u * v
        return total

    metric = metric_name(metric)
    if metric == "l2":
        away = x - q
        return inner(away, away)
    if metric == "dot":
        return -inner(x, q)
    return 1 - inner(x, q) / np.maximum(np.sqrt(inner(x, x) * inner(q, q)), EPSILON)


def below(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For rows of x and rows of q, what paired gives less some rounding errors: a lower bound, by one matrix product.

    NaN, that is no bound, where components are not finite or so large that squares may overflow."""
    metric, dims = metric_name(metric), x.shape[1]
    slack = 8 * (dims + 8) * np.finfo(np.float64).eps

    def product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """The matrix product of x, scaled, and q, each with further columns."""
        return np.column_stack(left) @ np.column_stack(right).T

    with np.errstate(all="ignore"):
        xx, qq = (np.where((s := (a * a).sum(1)) < 1e150, s, np.nan) for a in (x, q))
        if metric == "l2":
            return product([-2 * x, xx * (1 - slack), np.ones(len(x))], [q, np.ones(len(q)), qq * (1 - slack) - 1e-300])
        if metric == "dot":
            far = [np.where(np.isnan(s), np.nan, math.sqrt(dims) * np.abs(a).max(1, initial=0)) for s, a in ((xx, x), (qq, q))]
            return product([-x, -far[0], np.full(len(x), -1e-300)], [q, slack * far[1], np.ones(len(q))])
        if xx.size and qq.size and xx.min() * qq.min() > 4 * EPSILON**2:  # false where any is NaN
            return product([-x / np.sqrt(xx)[:, None], np.full(len(x), 1 - slack)], [q / np.sqrt(qq)[:, None], np.ones(len(q))])
        return 1 - slack - x @ q.T / np.maximum(np.sqrt(np.multiply.outer(xx, qq)), EPSILON)
