"""The rows that count: newest version of each key, and end points that are vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per ``key`` the ``columns`` of the row with the greatest ``order``.

    A row whose ``order`` is null is older than every other row. Rows that tie on ``order`` are settled
    by the greatest columns in the order given (null is least), so the result never depends on the
    partitioning. Rows with a null key are dropped. One shuffle by ``key``, combined on the map side.
    """
    packed = F.struct(F.col(order).alias("_order"), *[F.col(c) for c in columns])
    won = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(packed).alias("_r"))
    return won.select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def domain(ids: DataFrame, key: str = "id") -> tuple[int, bool]:
    """(greatest id + 1, whether every integer from 0 to it occurs); one small result."""
    top, low, n = ids.agg(F.max(key), F.min(key), F.count_distinct(key)).first()
    if top is None:
        return 0, True
    return top + 1, low == 0 and n == top + 1


def is_member(ids: DataFrame, columns: list[str], df: DataFrame, key: str = "id", known: tuple[int, bool] | None = None) -> DataFrame:
    """Rows of ``df`` whose ``columns`` are all non-null and ids in ``ids``.

    Dense ids (0..n-1, checked) need no join: the test is a range filter that reaches the scan. Any other
    set of ids is tested by one semi join per column. ``known`` is the ``domain`` of ids, if it was taken before.
    """
    n, dense = known or domain(ids, key)
    if dense:
        return df.where(in_range(columns, n))
    for c in columns:
        d = ids.select(F.col(key).alias("_m")).where(F.col("_m").isNotNull()).distinct()
        df = df.join(d, df[c] == d["_m"], "left_semi")
    return df


def in_range(columns: list[str], n: int) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull() & (F.col(c) >= 0) & (F.col(c) < n)
    return cond


def valid_edges(edges: DataFrame, vertices: DataFrame, columns: tuple[str, ...] = ("src", "dst", "weight"), known: tuple[int, bool] | None = None) -> DataFrame:
    """The newest row of each edge_id, if both its end points are vertices: edge_id and ``columns``."""
    need = list(dict.fromkeys(("src", "dst", *columns)))
    newest = latest(edges, "edge_id", "loaded_at", need)
    return is_member(vertices, ["src", "dst"], newest, known=known).select("edge_id", *columns)
