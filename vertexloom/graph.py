"""The graph: integer-id vertices 0..nv-1 and directed edges, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``edges`` has src, dst and, if ``weighted``, weight; multi-edges and self-loops are kept.

    Every id of 0..nv-1 is a vertex, whether an edge touches it or not.
    """

    edges: DataFrame
    nv: int
    weighted: bool = False

    @staticmethod
    def from_edges(edges: DataFrame, nv: int | None = None, weighted: bool = False, check: bool = True) -> "Graph":
        """``nv`` defaults to the greatest end point plus one. With ``check``, an end point that is
        null or outside 0..nv-1 raises ValueError (one scan)."""
        cols = [F.col("src").cast("bigint"), F.col("dst").cast("bigint")] + ([F.col("weight").cast("int")] if weighted else [])
        edges = edges.select(*cols)
        if check or nv is None:
            low, high, bad = edges.agg(
                F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst")), F.count_if(F.col("src").isNull() | F.col("dst").isNull())
            ).first()
            if nv is None:
                nv = 0 if high is None else high + 1
            if check and (bad or (low is not None and (low < 0 or high >= nv))):
                raise ValueError(f"edge end points must be in 0..{nv - 1} and not null")
        return Graph(edges, nv, weighted)

    @property
    def spark(self):
        return self.edges.sparkSession

    @property
    def vertices(self) -> DataFrame:
        return self.spark.range(self.nv)

    def symmetrize(self) -> "Graph":
        """Every edge in both directions (self-loops twice, as a plain union)."""
        swapped = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["weight"] if self.weighted else []))
        return Graph(self.edges.unionByName(swapped), self.nv, self.weighted)

    def collapse(self) -> DataFrame:
        """Distinct (src, dst) with their multiplicity ``m``: for SUM programs send m·x, for MIN and MAX x."""
        return self.edges.groupBy("src", "dst").agg(F.count("*").alias("m"))

    def persist(self) -> "Graph":
        return Graph(self.edges.persist(), self.nv, self.weighted)
