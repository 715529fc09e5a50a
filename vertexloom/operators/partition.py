"""Edge-balanced contiguous vertex ranges, and what each range needs from the others."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.index import block_sums, csc_offsets
from vertexloom.session import discard, stored

#: Offsets of at most so many vertices (16 MB) are cut on the driver; more are cut by one query a range.
DRIVER_VERTICES = 2_000_000


def edge_balanced_bounds(g: Graph, parts: int, driver_vertices: int = DRIVER_VERTICES) -> DataFrame:
    """``part, row_left, row_right`` (inclusive): greedy ranges with about ne / parts in-edges each.

    A range ends with the vertex whose in-edges take it past ceil(ne / parts); the count then starts
    again from zero. The last range always ends at nv - 1; ranges left over are empty
    (row_left = nv, row_right = nv - 1).
    """
    if parts < 1:
        raise ValueError("parts must be positive")
    spark, nv = g.spark, g.nv
    cap = -(-g.edges.count() // parts)
    cuts: list[int] = []
    if nv and nv <= driver_vertices:
        t = csc_offsets(g).select("id", "in_end").toArrow()
        ends = np.empty(nv, np.int64)
        ends[t.column("id").to_numpy()] = t.column("in_end").to_numpy()
        base = 0
        while len(cuts) < parts - 1:
            v = int(np.searchsorted(ends, base + cap, side="right"))
            if v >= nv:
                break
            cuts.append(v)
            base = int(ends[v])
    elif nv:
        ends_df = stored(csc_offsets(g).select("id", "in_end"))
        base = 0
        while len(cuts) < parts - 1:
            row = ends_df.where(F.col("in_end") > base + cap).agg(F.min_by("id", "in_end"), F.min("in_end")).first()
            if row[0] is None:
                break
            first = ends_df.where(F.col("in_end") == row[1]).agg(F.min("id")).first()[0]
            cuts.append(first)
            base = row[1]
        discard(ends_df)
    rows, left = [], 0
    for p in range(parts):
        right = cuts[p] if p < len(cuts) else nv - 1
        rows.append((p, left, max(right, left - 1)))
        left = max(right + 1, left)
    return spark.createDataFrame(rows, "part int, row_left long, row_right long")


def check_bounds(bounds: DataFrame, nv: int) -> None:
    """ValueError unless the ranges are disjoint, in order of their parts, and together hold exactly 0..nv-1."""
    at = 0
    for p, r in enumerate(bounds.orderBy("part").collect()):
        if r.part != p or r.row_left != at or r.row_right < r.row_left - 1:
            raise ValueError(f"part {r.part} holds {r.row_left}..{r.row_right}, but {at} comes next")
        at = r.row_right + 1
    if at != nv:
        raise ValueError(f"the parts end at {at - 1}, the vertices at {nv - 1}")


def with_part(df: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """``df`` with the ``part`` whose range holds ``key``; bounds has one row a part, so it is a literal lookup."""
    rights = [r.row_right for r in bounds.orderBy("part").collect()]
    part = F.lit(len(rights) - 1)
    for p in range(len(rights) - 2, -1, -1):
        part = F.when(F.col(key) <= rights[p], p).otherwise(part)
    return df.withColumn("part", part.cast("int"))


def in_neighbors_by_part(g: Graph, bounds: DataFrame) -> DataFrame:
    """``part, src``: the distinct sources of the in-edges of each range."""
    return with_part(g.edges, bounds, "dst").select("part", "src").distinct()


def out_degree_by_part(g: Graph, bounds: DataFrame) -> DataFrame:
    """``part, src, out_degree`` counting only edges that end in the range."""
    return with_part(g.edges, bounds, "dst").groupBy("part", "src").agg(F.count("*").alias("out_degree"))


def csr_offsets_by_part(g: Graph, bounds: DataFrame) -> DataFrame:
    """``part, src, out_degree, out_end``: row pointers of each range's own edges laid out by source.

    A range's edges are those that end in it; they start where the edges of the ranges before it end. Only
    sources with an edge into the range have a row. Sums run in blocks of ids, so a range is not one task.
    """
    local = out_degree_by_part(g, bounds)
    sums = block_sums(local, "src", g.nv, "out_degree", "out_end", ["part"])
    return sums.select("part", "src", "out_degree", "out_end")
