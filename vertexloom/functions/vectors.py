"""Fixed-length vectors held as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def names(prefix: str, k: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(k)]


def dot(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x + y, [F.col(x) * F.col(y) for x, y in zip(a, b)])


def axpy(v: list[str], g: list[str], lam: float, gamma: float) -> list[Column]:
    """v + gamma * (g - lam * v), item by item, keeping the names of ``v``; a null g counts as 0."""
    return [(F.col(a) + gamma * (F.coalesce(F.col(b), F.lit(0.0)) - lam * F.col(a))).alias(a) for a, b in zip(v, g)]
