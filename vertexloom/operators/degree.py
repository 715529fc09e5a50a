"""Degrees and end-point checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.graph import Graph


def _counted(g: Graph, end: str, name: str) -> DataFrame:
    """Counts for every vertex in one exchange: the zero rows of the vertices join the same aggregation."""
    ones = g.edges.select(F.col(end).alias("id"), F.lit(1).cast("bigint").alias("_c"))
    zeros = g.vertices.select("id", F.lit(0).cast("bigint").alias("_c"))
    return ones.unionByName(zeros).groupBy("id").agg(F.sum("_c").alias(name))


def out_degree(g: Graph) -> DataFrame:
    """``id, out_degree`` for every vertex, multi-edges counted."""
    return _counted(g, "src", "out_degree")


def in_degree(g: Graph) -> DataFrame:
    """``id, in_degree`` for every vertex, multi-edges counted."""
    return _counted(g, "dst", "in_degree")


def bad_endpoints(g: Graph) -> int:
    """Edges with an end point outside 0..nv-1 or null."""
    ok = F.col("src").between(0, g.nv - 1) & F.col("dst").between(0, g.nv - 1)
    return g.edges.where(~F.coalesce(ok, F.lit(False))).count()


def endpoint_report(g: Graph) -> DataFrame:
    """One row: ``n_edges, bad_src, bad_dst, bad_edges``, where an end point is bad if null or outside 0..nv-1."""
    bad = lambda c: ~F.coalesce(F.col(c).between(0, g.nv - 1), F.lit(False))
    return g.edges.agg(F.count("*").alias("n_edges"), F.count_if(bad("src")).alias("bad_src"), F.count_if(bad("dst")).alias("bad_dst"), F.count_if(bad("src") | bad("dst")).alias("bad_edges"))


def graph_stats(g: Graph, num_parts: int = 1) -> DataFrame:
    """One row: nv, ne, bytes of the binary file, and estimates of the memory of a one-pass program.

    ``file_bytes`` is header + offsets + sources (+ weights). ``state_bytes`` is the vertex state of a
    scalar program (id and value), ``edge_bytes`` the edge table, both a partition when ``num_parts``
    partitions share them.
    """
    width = 8 if g.weighted else 4
    one = g.edges.agg(F.count("*").alias("ne"))
    nv = F.lit(g.nv).cast("bigint")
    return one.select(
        nv.alias("nv"),
        "ne",
        (F.lit(12) + F.lit(8) * nv + F.lit(width) * F.col("ne")).alias("file_bytes"),
        F.ceil(F.lit(16) * nv / num_parts).alias("state_bytes"),
        F.ceil(F.lit(width + 12) * F.col("ne") / num_parts).alias("edge_bytes"),
    )


#: Bytes of an id, an edge offset, a directed edge with one or both ends, and a vertex record of the
#: programs' memory reports; queue slots are (rows - 1) // 16 + 100 ids and 8 bytes a part.
ID, OFFSET, ONE_END, BOTH_ENDS = 4, 8, 4, 8
SPARSE, SLACK, QUEUE_HEAD = 16, 100, 8


def memory_report(g: Graph, bounds: DataFrame, program: str) -> DataFrame:
    """``program, part, edges, vertices, part_bytes, max_part_bytes, shared_bytes, part_mb, shared_mb``.

    What a one-pass program holds for each part (its edges, vertex records, states and a copy of all states)
    and what all parts share (the graph as read, both states, queues). The settings that suffice are the
    greatest part's and the shared bytes in whole megabytes, plus one. program: pagerank, sssp, components.
    """
    if program not in ("pagerank", "sssp", "components"):
        raise ValueError("there is a memory report for pagerank, sssp and components")
    pull, nv = program == "pagerank", g.nv
    ranges = bounds.orderBy("part").collect()
    part = F.lit(len(ranges) - 1)
    for r in reversed(ranges[:-1]):
        part = F.when(F.col("dst") <= r.row_right, r.part).otherwise(part)
    n = {r.part: r.n for r in g.edges.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).collect()}
    ne, node, state = sum(n.values()), 16 if pull else 8, 4
    queue = sum(QUEUE_HEAD + ID * (max(0, r.row_right - r.row_left) // SPARSE + SLACK) for r in ranges)
    rows = []
    for r in ranges:
        e, v = n.get(r.part, 0), r.row_right - r.row_left + 1
        if pull:
            size = e * BOTH_ENDS + v * (node + ID + state) + nv * state
        else:
            size = e * (BOTH_ENDS + ONE_END) + v * (node + 2 * state) + nv * (node + state) + 2 * queue
        rows.append((program, r.part, e, v, size))
    shared = ne * ID + nv * OFFSET + 2 * nv * state
    shared += nv * ID if pull else 2 * queue + nv * node + max((x[2] for x in rows), default=0) * ONE_END
    most = max((x[4] for x in rows), default=0)
    mb = lambda b: b // 2**20 + 1
    return g.spark.createDataFrame([(*x, most, shared, mb(most), mb(shared)) for x in rows], "program string, part int, edges bigint, vertices bigint, part_bytes bigint, max_part_bytes bigint, shared_bytes bigint, part_mb bigint, shared_mb bigint")
