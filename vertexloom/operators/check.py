"""Fixpoint checks of hop counts and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.message import EdgeIndex
from vertexloom.operators.partition import with_part


def _ends(g: Graph, labels: DataFrame, value: str) -> DataFrame:
    i = EdgeIndex(g)
    s = labels.select("id", F.col(value).alias("a"))
    t = labels.select("id", F.col(value).alias("b"))
    return i.with_target(i.gather(s), t)


def _by_part(rows: DataFrame, g: Graph, bounds: DataFrame | None) -> DataFrame:
    """Mistakes of each part (part 0 is the whole graph without ``bounds``), parts without any included."""
    spark = g.spark
    if bounds is None:
        parts = spark.range(1).select(F.col("id").cast("int").alias("part"))
        rows = rows.select(F.lit(0).alias("part"), "bad")
    else:
        parts = bounds.select("part")
        rows = with_part(rows, bounds, "dst").select("part", "bad")
    n = rows.groupBy("part").agg(F.sum(F.col("bad").cast("bigint")).alias("mistakes"))
    return parts.join(F.broadcast(n), "part", "left").select("part", F.coalesce("mistakes", F.lit(0)).cast("bigint").alias("mistakes")).withColumn("passed", F.col("mistakes") == 0)


def check_sssp(g: Graph, hops: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """``part, mistakes, passed``: edges whose source is reached and whose target is farther than one more hop."""
    e = _ends(g, hops, "hops")
    return _by_part(e.select("dst", ((F.col("a") != g.nv) & (F.col("b") > F.col("a") + 1)).alias("bad")), g, bounds)


def check_components(g: Graph, labels: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """``part, mistakes, passed``: edges whose target has a smaller label than their source."""
    e = _ends(g, labels, "label")
    return _by_part(e.select("dst", (F.col("b") < F.col("a")).alias("bad")), g, bounds)


def unattained(g: Graph, labels: DataFrame, value: str, step: int, initial) -> DataFrame:
    """``id`` of vertices whose non-initial value no in-edge explains: the other side of the two checks.

    ``step`` is what an edge adds (1 for hops, 0 for labels); ``initial`` a Column that is true where the
    value is the starting one.
    """
    e = _ends(g, labels, value)
    held = e.where(F.col("b") == F.col("a") + step).select(F.col("dst").alias("id")).distinct()
    return labels.where(~initial).join(held, "id", "left_anti").select("id")
