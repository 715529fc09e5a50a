"""The four ready-made programs."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.vectors import axpy, dot, names
from vertexloom.graph import Graph
from vertexloom.operators.degree import out_degree
from vertexloom.operators.message import EdgeIndex
from vertexloom.plans.iterate import Trace, pull_iterate, push_iterate
from vertexloom.session import discard, stored

# Fixed values of the programs.
PAGERANK_ALPHA = 0.15
CF_K = 20
CF_LAMBDA = 0.001
CF_GAMMA = 3.5e-7


def pagerank(g: Graph, num_iter: int = 10, alpha: float = PAGERANK_ALPHA, precision: str = "double", every: int = 1) -> DataFrame:
    """``id, value, rank, out_degree`` after exactly ``num_iter`` steps.

    value is kept divided by the out-degree (a dangling vertex divides by 1, and its mass is not
    redistributed): x' = ((1 - alpha) / nv + alpha * sum of x over in-edges) / max(1, out_degree), from
    x = 1 / nv / max(1, out_degree). rank = value * max(1, out_degree). ``precision="float"`` rounds
    the state to 32 bits after each step.
    """
    if num_iter < 1:
        raise ValueError("num_iter must be positive")
    cast = {"double": "double", "float": "float"}[precision]
    deg = F.greatest(F.col("deg"), F.lit(1))
    start = stored(out_degree(g).select("id", F.col("out_degree").alias("deg")))
    state = start.select("id", (F.lit(1.0) / F.lit(g.nv) / deg).cast(cast).cast("double").alias("value"), "deg")
    step = (F.lit((1 - alpha) / max(1, g.nv)) + F.lit(alpha) * F.coalesce("msg", F.lit(0.0))) / deg
    out = pull_iterate(g, state, F.col("value"), "sum", {"value": step.cast(cast).cast("double")}, num_iter, every)
    if num_iter > 1:
        discard(start)
    return out.select("id", "value", (F.col("value") * deg).alias("rank"), F.col("deg").alias("out_degree"))


def sssp(g: Graph, start: int = 0, mode: str = "auto", trace: Trace | None = None, nullable: bool = False) -> DataFrame:
    """``id, hops``: least number of edges from ``start`` (weights play no part); nv, or null with
    ``nullable``, where it can't be reached. A start outside the graph reaches nothing."""
    state = g.vertices.select("id", F.when(F.col("id") == start, 0).otherwise(g.nv).cast("bigint").alias("label"))
    out = push_iterate(g, state, F.col("label") + 1, "min", int(0 <= start < g.nv), F.col("id") == start, mode, trace)
    hops = F.when(F.col("label") < g.nv, F.col("label")) if nullable else F.col("label")
    return out.select("id", hops.alias("hops"))


def components(g: Graph, mode: str = "auto", trace: Trace | None = None, symmetrize: bool = False) -> DataFrame:
    """``id, label``: the greatest id that reaches the vertex along directed edges, itself included.

    With ``symmetrize`` every edge counts in both directions, which gives the classic undirected components.
    """
    g = g.symmetrize() if symmetrize else g
    state = g.vertices.select("id", F.col("id").alias("label"))
    return push_iterate(g, state, F.col("label"), "max", g.nv, None, mode, trace)


def colfilter(g: Graph, num_iter: int = 10, k: int = CF_K, lam: float = CF_LAMBDA, gamma: float = CF_GAMMA, init: float | None = None, start: DataFrame | None = None) -> DataFrame:
    """``id, v ARRAY<DOUBLE>`` after ``num_iter`` full-batch gradient steps of matrix factorisation.

    Every item starts as sqrt(1 / k) (or ``init``, or the vectors of ``start``: id, v). A step reads only
    old vectors: v' = v + gamma * (sum over in-edges of (weight - <u, v>) * u - lam * v).
    The k items are k columns, so the products and the k sums are generated code.
    """
    if num_iter < 1:
        raise ValueError("num_iter must be positive")
    if not g.weighted:
        raise ValueError("collaborative filtering needs weighted edges")
    own, src, dst = names("v", k), names("u", k), names("p", k)
    if start is None:
        state = g.vertices.select("id", *[F.lit(sqrt(1 / k) if init is None else init).alias(c) for c in own])
    else:
        state = start.select("id", *[F.col("v")[i].alias(c) for i, c in enumerate(own)])
    index, last = EdgeIndex(g, k, keep=num_iter > 1), None
    for i in range(num_iter):
        u = state.select("id", *[F.col(a).alias(b) for a, b in zip(own, src)])
        p = state.select("id", *[F.col(a).alias(b) for a, b in zip(own, dst)])
        e = index.with_target(index.gather(u), p).select("dst", *src, (F.col("weight") - dot(src, dst)).alias("err"))
        sums = e.groupBy(F.col("dst").alias("id")).agg(*[F.sum(F.col("err") * F.col(c)).alias(c) for c in src])
        both = state.join(sums, "id", "left")
        state = both.select("id", *axpy(own, src, lam, gamma))
        if num_iter > 1:
            state = stored(state)
            discard(last)
            last = state
    index.release()
    return state.select("id", F.array(*own).alias("v"))
